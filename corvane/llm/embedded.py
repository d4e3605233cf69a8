"""Quality classifier: supervised subword embeddings. A document is the mean of learned vectors of its hashed n-grams (words, pairs of words, and
the characters of words), a softmax over two classes judges the mean, and both are trained together by stochastic gradient descent in numpy.

N-grams of characters are those of 3 to 5 code points within a word and its two borders. A pair of equal words is one n-gram whatever the
word, so that repetition is learned as such; the end of a text is an n-gram too, so that an empty text has a vector. All hashes are polynomials
over code points, taken for whole batches of texts at once; they fall into BUCKETS.

The network is trained on at most SAMPLE labelled rows (the first by a hash of the id), none of them held out; of such a row come counts
of at most BUCKETS n-grams to the driver, whatever its length. A trained document score needs only one number a bucket:
the mean commutes with the output layer, so each bucket's vector is multiplied by it once, and texts are scored by table look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod

BUCKETS, DIM, SAMPLE = 1 << 14, 16, 3_000
EPOCHS, RATE = 5, 0.5
GRAMS = (3, 4, 5)
LEAST = 0.3
#: Code points that are hashed at once; a longer word is cut there.
PIECE = 1 << 17
END, SAME = 0, 1
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Buckets of hashes; the first two are END's and SAME's."""
    h = h * _PRIME
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS - 2) + np.uint64(2)).astype(np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def grams(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of code points that begin and end with a border, where each begins, and where its second word does (or itself)."""
    space = (chars < 256) & _SPACE[np.minimum(chars, 255)]
    n = len(chars)
    c = np.where(space, 1, chars + 2).astype(np.uint64)  # all borders are one character
    out, at = [], []
    inside = np.concatenate(([0], np.cumsum(space)))
    h = np.zeros(n, np.uint64)
    for k in range(1, min(max(GRAMS), n) + 1):
        h = h[: n - k + 1] * np.uint64(1_000_003) + c[k - 1 :]
        if k in GRAMS:
            start = np.flatnonzero(inside[k - 1 : n] == inside[1 : n - k + 2])  # no border but at the ends
            out.append(_mix(h[start] + np.uint64(k)))
            at.append(start)
    place = np.arange(n)
    place -= np.maximum.accumulate(np.where(space, place, 0))
    starts = np.flatnonzero(place == 1)
    if not len(starts):
        return np.concatenate(out or [starts]), np.concatenate(at or [starts]), np.concatenate(at or [starts])
    scrambled = c * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _PRIME
    scrambled ^= scrambled >> np.uint64(31)
    scrambled *= np.uint64(0x94D049BB133111EB)
    scrambled[space] = 0
    words = np.add.reduceat(scrambled, starts)
    pairs = np.where(words[:-1] == words[1:], SAME, _mix(words[:-1] * np.uint64(31) + words[1:] + np.uint64(7)))
    begin = np.concatenate((*at, starts, starts[:-1]))
    return np.concatenate((*out, _mix(words), pairs)), begin, np.concatenate((*at, starts, starts[1:]))


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of several texts, and the number of the text that each is of. A text's last border is the next one's first."""
    chars = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    bucket, at, second = grams(chars)
    first = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(first, at, side="right")
    mine = owner == np.searchsorted(first, second, side="right")  # else a pair's words stand in two texts
    return bucket[mine], owner[mine]


def pieces(text: str):
    """A text in pieces of at most PIECE code points, cut between words where it can be."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        if hi < len(text):
            cut = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi))
            hi = cut if cut > lo else hi
        yield text[lo:hi]
        lo = hi


def counts(text: str) -> np.ndarray:
    """How often a text has an n-gram of each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    out[END] = 1
    for piece in pieces(text):
        out += np.bincount(hashed([piece])[0], minlength=BUCKETS)
    return out


@dataclass
class Network:
    vectors: np.ndarray  # BUCKETS x DIM
    out: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: counts, texts x BUCKETS."""
        logits = (x / x.sum(axis=1, keepdims=True)) @ self.vectors @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)

    def table(self) -> tuple[np.ndarray, float]:
        """By bucket, by how much class 1 is ahead; and the same of the bias."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def gradients(net: Network, ids: np.ndarray, share: np.ndarray, y: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of one document, and the gradients of its vectors' mean, of out and of bias. share: of each of its n-grams."""
    mean = share @ net.vectors[ids]
    logits = mean @ net.out + net.bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    d = p.copy()
    d[y] -= 1
    return -float(np.log(max(p[y], 1e-12))), net.out @ d, np.outer(mean, d), d


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """rows: (buckets, counts, label). Every epoch visits every row once, in an order of its own, at a rate that falls to nothing."""
    rng = np.random.default_rng(seed)
    net = Network(rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM, np.zeros((DIM, 2)), np.zeros(2))
    net.out[:] = rng.uniform(-1, 1, (DIM, 2)) / DIM
    shares = [c / c.sum() for _, c, _ in rows]
    done, total = 0, max(epochs * len(rows), 1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / total)
            ids, _, y = rows[i]
            _, d_mean, d_out, d_bias = gradients(net, ids, shares[i], y)
            # A mean of thousands of vectors hands each of them a tiny part of its gradient: as many times the rate, as if each stood alone.
            net.vectors[ids] -= rate * np.outer(np.minimum(shares[i] * len(ids), 4.0), d_mean)
            net.out -= rate * d_out
            net.bias -= rate * d_bias
            done += 1
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    ids = labels.select(F.col("doc_id").cast("bigint").alias("_l"), (F.col("quality") == 1).cast("int").alias("y")).dropna().filter(crc_mod(F.col("_l"), 5) != 0)
    ids = ids.groupBy("_l").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_l"), "_l").limit(SAMPLE)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), F.col("id") == F.col("_l")).select("id", "y", "text")

    def work(batches):
        for batch in batches:
            for i, y, text in zip(*(c for c in batch.columns), strict=True):
                found = counts(text.as_py())
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()]), pa.array([y.as_py()], pa.int32()), pa.array([at.astype(np.int16).tobytes()]), pa.array([np.minimum(found[at], 2**31 - 1).astype(np.int32).tobytes()])], names=["id", "y", "at", "c"])

    got = rows.mapInArrow(work, "id bigint, y int, at binary, c binary").orderBy(F.xxhash64("id"), "id", "at", "c").limit(SAMPLE).collect()  # rows that share an id count too
    if len({r.y for r in got}) < 2:
        return None if not got else Network(np.zeros((BUCKETS, DIM)), np.zeros((DIM, 2)), np.array([0.0, 20.0 if got[0].y else -20.0]))
    return train([(np.frombuffer(r.at, np.int16).astype(np.int64), np.frombuffer(r.c, np.int32), r.y) for r in got])


def scores(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The probability of class 1 for each text; short texts are hashed many at once."""
    total, n = np.full(len(texts), table[END]), np.ones(len(texts))
    held: list[tuple[int, str]] = []
    size = 0

    def count():
        bucket, owner = hashed([p for _, p in held])
        at = np.array([i for i, _ in held])[owner]
        total[:] += np.bincount(at, table[bucket], len(texts))
        n[:] += np.bincount(at, minlength=len(texts))
        held.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text):
            if held and size + len(piece) > PIECE:
                count()
                size = 0
            held.append((i, piece))
            size += len(piece)
    if held:
        count()
    return 1 / (1 + np.exp(-np.clip(total / n + bias, -500, 500)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= LEAST) for every row.

    A null text is empty; an empty text has its end only. Rows that repeat are scored alike; a null id is not held out. With labels of
    one kind every score is that label's; without any, 0.5. Texts of any length are read whole, in pieces; an empty table gives an
    empty one; further columns of any name aren't read.
    """
    net = net or fit(docs, labels, id_col, text_col)
    table, bias = net.table() if net is not None else (np.zeros(BUCKETS), 0.0)

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                s = scores(part.column(2).to_pylist(), table, bias)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= LEAST).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ident = F.col(f"`{id_col}`").cast("bigint")
    rows = docs.select(ident.alias("doc_id"), F.coalesce(crc_mod(ident, 5) == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")
