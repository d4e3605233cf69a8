"""Toxicity: boosted trees over dense features of a whole text, calibrated by isotonic regression.

Features are densities of a lexicon (written plainly, and disguised), nearness of its words to the second person,
rates of capitals, punctuation and disguises. The lexicon is learned too: words whose documents are far more often
labelled toxic. Lexicon, trees and calibration are fitted on at most SAMPLE labelled rows (the first by a hash of the id),
none of them held out; everything else covers all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CACHED, crc_mod, slices

SAMPLE, LEXICON, BINS, ROUNDS, DEPTH, RATE = 20_000, 200, 32, 80, 3, 0.15
#: One labelled row in so many calibrates and teaches nothing else.
CALIBRATION = 10
#: Toxic documents a word of the lexicon stands in.
LEAST_DOCS = 5
#: Second person in the four languages. Fixed values.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
#: Characters that stand for letters. Fixed values.
LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGES = " \t\n\r\v\f.,;:!?\"'()[]{}<>|#*$%&~_-+=/\\"
_RUN = re.compile(r"(.)\1+")
_STRETCHED = re.compile(r"(.)\1\1")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 58, 59, 60, 61, 62, 63, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = True

FEATURES = ["words", "plain", "plain_n", "disguised", "disguised_n", "kinds", "weight", "near_you", "you", "caps", "caps_words", "punct", "exclaim", "question", "digits_inside", "signs_inside", "stretched", "symbols"]


class Words(dict):
    """word -> flags + 256 * (index in the lexicon, from 1; 0 for none), for words met lately. Flags: 1 plain, 2 disguised, 4 second person, 8 capitals,
    16 digit inside, 32 sign inside, 64 stretched, 128 single letter."""

    def __init__(self, lexicon: dict[str, float]):
        self.number = {w: i for i, w in enumerate(lexicon)}
        self.squeezed = {_RUN.sub(r"\1", w): i for w, i in self.number.items()}
        self.by_length: dict[int, list[tuple[str, int]]] = {}
        for w, i in self.number.items():
            self.by_length.setdefault(len(w), []).append((w, i))

    def _disguised(self, word: str) -> int:
        for plain in (word.translate(LEET), word):
            if "*" in plain and len(plain) > 3:
                for w, i in self.by_length.get(len(plain), ()):
                    if all(a in (b, "*") for a, b in zip(plain, w, strict=True)) and sum(a != "*" for a in plain) > 1:
                        return i
            bare = "".join(c for c in plain if c.isalpha())
            if bare != word:
                i = self.number.get(bare, -1)
                if i >= 0:
                    return i
            i = self.squeezed.get(_RUN.sub(r"\1", bare), -1)
            if i >= 0 and bare not in self.number:
                return i
        return -1

    def __missing__(self, raw: str) -> int:
        low = raw.lower()
        word, bare, inside = low.strip(_EDGES), low.strip(" .,;:?\"'()[]{}<>"), raw.strip(_EDGES)
        flags, at = 0, self.number.get(word, -1)
        letters = bare == word and inside.isalpha()  # most words: nothing to undo but stretching
        squeezed = _RUN.sub(r"\1", word) if letters else None
        if at >= 0:
            flags = 1
        elif word:
            at = self.squeezed.get(squeezed, -1) if letters and word.isalpha() else self._disguised(bare)
            flags = 2 if at >= 0 else 0
        if word in SECOND_PERSON:
            flags |= 4
        if len(inside) > 1 and inside.isupper():
            flags |= 8
        if not letters:
            if any(map(str.isdigit, inside)) and any(map(str.isalpha, inside)):
                flags |= 16
            if any(not c.isalnum() and c not in "'-.,/" for c in inside):
                flags |= 32
        if squeezed != word and _STRETCHED.search(inside):
            flags |= 64
        if len(word) == 1 and word.isalpha():
            flags |= 128
        if len(self) > 200_000:
            self.clear()
        found = flags | (at + 1) << 8
        if len(raw) <= CACHED:
            self[raw] = found
        return found


def features(text: str, words: Words, weights: np.ndarray) -> list[float]:
    parts = text.split()
    n = max(len(parts), 1)
    codes = np.fromiter(map(words.__getitem__, parts), np.int32, len(parts))
    flags, at = codes & 255, (codes >> 8) - 1
    hits = np.flatnonzero(flags & 3)
    spelled = 0
    single = np.flatnonzero(flags & 128)
    if len(single) > 2:  # l e t t e r s set apart
        for run in np.split(single, np.flatnonzero(np.diff(single) != 1) + 1):
            if len(run) > 2 and words.number.get("".join(parts[i].lower().strip(_EDGES) for i in run), -1) >= 0:
                spelled += 1
    you = np.flatnonzero(flags & 4)
    near = 0
    if len(hits) and len(you):
        i = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - hits), np.abs(hits - you[np.maximum(i - 1, 0)]))
        near = int((gap <= 3).sum())
    b = np.frombuffer(text.encode(), np.uint8)
    letters = max(int(_LETTER[b].sum()), 1)
    chars = max(len(b), 1)
    plain, hidden = int((flags & 1 > 0).sum()), int((flags & 2 > 0).sum()) + spelled
    kinds = np.unique(at[hits])
    share = lambda bit: float((flags & bit > 0).sum()) / n
    return [
        np.log1p(len(parts)),
        plain / n,
        plain,
        hidden / n,
        hidden,
        len(kinds),
        float(weights[at[hits]].sum()) if len(hits) else 0.0,
        near,
        len(you) / n,
        float(_UPPER[b].sum()) / letters,
        share(8),
        float(_PUNCT[b].sum()) / chars,
        text.count("!") / n,
        text.count("?") / n,
        share(16),
        share(32),
        share(64),
        sum(map(text.count, "#*$%&|<>")) / n,
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    edges: np.ndarray  # features x (BINS - 1): where bins begin
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin by inner node, value by leaf
    base: float
    at: np.ndarray  # of the calibration: margins, probabilities
    to: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)
        return _margins(bins, self.trees, self.base)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margins(x), self.at, self.to), 0.0, 1.0)


def _margins(bins, trees, base):
    out = np.full(len(bins), base)
    rows = np.arange(len(bins))
    for feature, cut, value in trees:
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        out += value[node - (2**DEPTH - 1)]
    return out


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray):
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for level in range(DEPTH):
        low = 2**level - 1
        for k in range(low, 2 * low + 1):
            mine = node == k
            if mine.sum() < 20:
                continue
            b, g, h = bins[mine], grad[mine], hess[mine]
            best = 1e-6
            for f in range(bins.shape[1]):
                gl, hl = (np.cumsum(np.bincount(b[:, f], w, BINS))[:-1] for w in (g, h))
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, feature[k], cut[k] = float(gain[j]), f, j
        node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
    leaf = node - inner
    value = -RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
    return (feature, cut, value), value[leaf]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and values of a rising step function, to be joined by lines."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    at = np.array([v for s, n, lo, hi in blocks for v in (lo, hi)])
    to = np.array([v for s, n, lo, hi in blocks for v in (s / n, s / n)])
    return at, to


def fit_trees(x: np.ndarray, y: np.ndarray, lexicon: dict[str, float], cal: np.ndarray) -> Model:
    """Trees on the rows that cal leaves out, calibration on those that it marks; on all rows if one part lacks a label."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(lexicon, np.zeros((x.shape[1] if x.ndim == 2 else len(FEATURES), 0)), [], 0.0, np.array([0.0]), np.array([rate]))
    if not (cal.any() and (~cal).any()) or not 0 < y[~cal].mean() < 1:
        cal = np.zeros(len(y), bool)
    edges = np.stack([np.quantile(x[~cal, f], np.linspace(0, 1, BINS + 1)[1:-1]) for f in range(x.shape[1])])
    bins = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)
    tb, ty = bins[~cal], y[~cal].astype(float)
    base = float(np.log(ty.mean() / (1 - ty.mean())))
    margin, trees = np.full(len(ty), base), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        tree, add = _grow(tb, p - ty, p * (1 - p))
        trees.append(tree)
        margin += add
    held = cal if cal.any() else np.ones(len(y), bool)
    at, to = isotonic(_margins(bins[held], trees, base), y[held].astype(float))
    return Model(lexicon, edges, trees, base, at, to)


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toxic, text, cal) of at most SAMPLE labelled ids that aren't held out; cal marks about one in CALIBRATION, for calibration only."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("_l"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(crc_mod(F.col("_l"), 5) != 0)
    ids = ids.groupBy("_l").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_l"), "_l").limit(SAMPLE)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), F.col("id") == F.col("_l")).select("id", "toxic", "text", (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(CALIBRATION)) == 0).alias("cal"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """The LEXICON words whose documents are most surely more often toxic, with their log odds."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.btrim(w, F.lit(_EDGES))))
    word = F.explode(words)
    n = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = (n.t or 0), (n.n or 0) - (n.t or 0)
    if not toxic or not clean:
        return {}
    counts = rows.select("toxic", word.alias("w")).filter("length(w) BETWEEN 3 AND 24").groupBy("w").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (F.lit(float(toxic)) - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (F.lit(float(clean)) - F.col("c") + 0.5))
    doubt = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = counts.select("w", odds.alias("o"), (odds - 2.5 * doubt).alias("sure"), "t").filter((F.col("t") >= LEAST_DOCS) & (F.col("sure") > 0.7)).orderBy(F.desc("sure"), "w").limit(LEXICON).collect()
    return {r.w: float(r.o) for r in found}


_FEATURED = "id bigint, toxic int, cal boolean, x array<double>"


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = _training(docs, labels, id_col, text_col)
    lexicon = learn_lexicon(rows.filter("NOT cal"))  # else words that a row has taught would calibrate on it

    def work(batches):
        words, weights = Words(lexicon), np.array([*lexicon.values(), 0.0])
        for batch in batches:
            for part in slices(batch, 2):
                x = [features(t, words, weights) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(x, pa.list_(pa.float64()))], names=["id", "toxic", "cal", "x"])

    got = rows.mapInArrow(work, _FEATURED).orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).collect()  # rows that share an id count too
    got.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array([r.toxic for r in got], int), lexicon, np.array([r.cal for r in got], bool))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null texts are empty and scored like any other; repeated rows alike.
    Without labels of both kinds the score is their rate (0 without any). Texts of any length are read whole; a score of exactly 0.5
    is predicted toxic; an empty table gives an empty one; further columns of any name aren't read."""
    model = model or fit(docs, labels, id_col, text_col)

    def work(batches):
        words, weights = Words(model.lexicon), np.array([*model.lexicon.values(), 0.0])
        for batch in batches:
            for part in slices(batch, 2):
                x = np.array([features(t or "", words, weights) for t in part.column(2).to_pylist()], float)
                s = model.scores(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ident = F.col(f"`{id_col}`").cast("bigint")
    rows = docs.select(ident.alias("doc_id"), F.coalesce(crc_mod(ident, 5) == 0, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")
