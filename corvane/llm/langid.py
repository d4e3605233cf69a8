"""Language identification: a bidirectional gated recurrent network over bytes, trained here in numpy.

A text's bytes are cut into segments of SEGMENT; over each, one network of HIDDEN gated units runs forward and one
backward, and every position gets a probability for each language. A document's probabilities are the means over all its
positions. Gates use x / (1 + |x|) in the place of the logistic curve and tanh. Training is backpropagation through time with
Adam, on whole texts of at most SAMPLE labelled documents, PER_LANG of a language at most (the first by a hash of the id, of at most PER_PART of each of SPREAD parts), so that a rare language is
learned too; no held-out row is among them. Each step draws documents, and of each any of its segments. Everything is seeded, so the same rows
give the same network.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import crc_mod, slices

SEGMENT, HIDDEN, SAMPLE, PER_LANG = 96, 8, 4_000, 750
STEPS, LANES, RATE = 300, 256, 0.02
#: Segments that run side by side when texts are labelled.
SLAB = 1024


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Network:
    langs: list[str]
    e: list[np.ndarray]  # by direction: input by byte, 256 x 3H (update, reset, candidate)
    u: list[np.ndarray]  # H x 3H
    b: list[np.ndarray]  # of u
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.e, *self.u, *self.b, self.out, self.bias]

    def states(self, x: np.ndarray) -> np.ndarray:
        """x: lanes x time. The states of both directions, time x lanes x 2H."""
        lanes, time = x.shape
        h = HIDDEN
        all_h = np.empty((time, lanes, 2 * h), np.float32)
        for d in (0, 1):
            e, u, b = self.e[d], self.u[d], self.b[d]
            hp = np.zeros((lanes, h), np.float32)
            for t in range(time) if d == 0 else range(time - 1, -1, -1):
                gx = e[x[:, t]]
                gh = hp @ u
                gh += b
                a = gx[:, : 2 * h] + gh[:, : 2 * h]
                den = np.abs(a)
                den += 1
                a /= den
                a += 1
                a *= 0.5
                n = gh[:, 2 * h :]
                n *= a[:, h:]
                n += gx[:, 2 * h :]
                den = np.abs(n)
                den += 1
                n /= den
                hp = hp - n
                hp *= a[:, :h]
                hp += n
                all_h[t, :, d * h : (d + 1) * h] = hp
        return all_h

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """time x lanes x languages."""
        logits = self.states(x) @ self.out
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits


def new_network(langs: list[str], seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return Network(langs, [f(256, 3 * HIDDEN, scale=0.5) for _ in "fb"], [f(HIDDEN, 3 * HIDDEN, scale=0.3) for _ in "fb"], [np.zeros(3 * HIDDEN, np.float32) for _ in "fb"], f(2 * HIDDEN, len(langs), scale=0.3), np.zeros(len(langs), np.float32))


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions under the mask, and its gradients in the order of params()."""
    lanes, time = x.shape
    h = HIDDEN
    kept: list[list] = [[None] * time, [None] * time]
    all_h = np.empty((time, lanes, 2 * h), net.out.dtype)
    for d in (0, 1):
        hp = np.zeros((lanes, h), net.out.dtype)
        for t in range(time) if d == 0 else range(time - 1, -1, -1):
            gx, gh = net.e[d][x[:, t]], hp @ net.u[d] + net.b[d]
            s = _soft(gx[:, : 2 * h] + gh[:, : 2 * h])
            g = 0.5 * (1 + s)
            z, r = g[:, :h], g[:, h:]
            n = _soft(gx[:, 2 * h :] + r * gh[:, 2 * h :])
            kept[d][t] = (hp, s, z, r, n, gh[:, 2 * h :])
            hp = n + z * (hp - n)
            all_h[t, :, d * h : (d + 1) * h] = hp
    logits = all_h @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    m = mask.T  # time x lanes
    total = max(m.sum(), 1)
    at = np.arange(lanes)
    loss = -(np.log(np.maximum(p[:, at, y], 1e-12)) * m).sum() / total
    p[:, at, y] -= 1
    p *= (m / total)[:, :, None]
    d_out = np.tensordot(all_h, p, axes=([0, 1], [0, 1]))
    d_bias = p.sum(axis=(0, 1))
    d_h = p @ net.out.T
    es, us, bs = [], [], []
    for d in (0, 1):
        du, db = np.zeros_like(net.u[d]), np.zeros_like(net.b[d])
        dgx = np.empty((time, lanes, 3 * h), net.out.dtype)
        carry = np.zeros((lanes, h), net.out.dtype)
        for t in range(time - 1, -1, -1) if d == 0 else range(time):
            hp, s, z, r, n, ghn = kept[d][t]
            dh = d_h[t, :, d * h : (d + 1) * h] + carry
            da = dh * (1 - z) * (1 - np.abs(n)) ** 2
            slope = 0.5 * (1 - np.abs(s)) ** 2
            gates = np.concatenate((dh * (hp - n) * slope[:, :h], da * ghn * slope[:, h:]), axis=1)
            dgx[t, :, : 2 * h], dgx[t, :, 2 * h :] = gates, da
            dgh = np.concatenate((gates, da * r), axis=1)
            du += hp.T @ dgh
            db += dgh.sum(axis=0)
            carry = dh * z + dgh @ net.u[d].T
        flat, rows = x.T.reshape(-1), dgx.reshape(-1, 3 * h)
        es.append(np.stack([np.bincount(flat, rows[:, k], 256) for k in range(3 * h)], axis=1).astype(net.out.dtype))
        us.append(du)
        bs.append(db)
    return float(loss), [*es, *us, *bs, d_out, d_bias]


def cut(text: bytes) -> list[bytes]:
    return [text[k : k + SEGMENT] for k in range(0, len(text), SEGMENT)]


def train(texts: list[bytes], y: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """texts: none is empty; y: the number of each one's language."""
    net, rng = new_network(langs, seed), np.random.default_rng(seed)
    pieces = [cut(t) for t in texts]
    x, mask = _padded([p for ps in pieces for p in ps])
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(sizes) - sizes
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    first = [np.zeros_like(p) for p in net.params()]
    second = [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(rows, -(-LANES // len(langs))) for rows in by_lang])
        pick = begin[docs] + (rng.random(len(docs)) * sizes[docs]).astype(np.int64)
        _, grads = gradients(net, x[pick], mask[pick], y[docs])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, m, v in zip(net.params(), grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    x = np.frombuffer(b"".join(s.ljust(SEGMENT, b"\0") for s in segments), np.uint8).reshape(-1, SEGMENT)
    return x, (np.arange(SEGMENT)[None, :] < sizes[:, None]).astype(np.float32)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; texts x languages."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    flat = np.frombuffer(b"".join(t.ljust(int(n) * SEGMENT, b"\0") for t, n in zip(texts, pieces, strict=True)), np.uint8).reshape(-1, SEGMENT)
    filled = np.full(len(owner), SEGMENT, np.int64)
    ends = np.cumsum(pieces) - 1
    some = sizes > 0
    filled[ends[some]] = (sizes - (pieces - 1) * SEGMENT)[some]
    sums = np.zeros((len(owner), len(net.langs)))
    for lo in range(0, len(owner), SLAB):
        p = net.probabilities(flat[lo : lo + SLAB])
        part = filled[lo : lo + SLAB]
        if (part < SEGMENT).any():
            p *= (np.arange(SEGMENT)[:, None] < part[None, :])[:, :, None]
        sums[lo : lo + SLAB] = p.sum(axis=0)
    out = np.zeros((len(texts), len(net.langs)))
    np.add.at(out, owner, sums)
    return out / np.maximum(sizes, 1)[:, None]


#: Parts of a language; of each, so many rows at most go on. More than PER_LANG in all, so that the first PER_LANG of a language by hash are nearly always among them.
SPREAD, PER_PART = 64, 40


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    ident = F.col(f"`{id_col}`").cast("bigint")
    rows = docs.select(ident.alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna().filter((crc_mod(F.col("id"), 4) != 2) & F.col("text").rlike(r"\p{L}"))
    # Ids first, so that a text is only carried for the sample; all languages have their first rows before any has its second.
    # The first of each of SPREAD parts of a language, then of all: no task sorts a language's rows.
    ids = rows.select(F.col("id").alias("_id"), F.col("lang").alias("_lang")).distinct().withColumn("_part", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(SPREAD)))
    for by in (["_lang", "_part"], ["_lang"]):
        ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("_id"), "_id"))).filter(F.col("_r") <= (PER_LANG if by == ["_lang"] else PER_PART))
    ids = ids.orderBy("_r", F.xxhash64("_id"), "_id", "_lang").limit(SAMPLE)
    got = rows.join(F.broadcast(ids), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("id", "lang", F.encode("text", "utf-8").alias("text"))
    got = got.orderBy(F.xxhash64("id"), "id", "lang", "text").limit(SAMPLE).collect()  # rows that share an id count too
    got.sort(key=lambda r: (r.id, r.lang, bytes(r.text)))
    if not got:
        return None
    langs = sorted({r.lang for r in got})
    return train([bytes(r.text) for r in got], np.array([langs.index(r.lang) for r in got]), langs)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row. A null text, or one without a letter, is und with score 0; so is
    every text if there is nothing to learn from. Rows that repeat are labelled alike; of equal probabilities the first language by
    name is taken. Texts of any length are read whole; an empty table gives an empty one; further columns of any name aren't read."""
    net = net or fit(docs, id_col, text_col, lang_col)

    def work(batches):
        for batch in batches:
            for part in slices(batch, 2):
                letters = part.column(3).to_pylist()
                texts = [(t or "").encode() for t in part.column(2).to_pylist()]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if net is not None:
                    p = pooled(net, texts)
                    for i, k in enumerate(p.argmax(axis=1)):
                        if letters[i]:
                            langs[i], scores[i] = net.langs[k], float(p[i, k])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    ident = F.col(f"`{id_col}`").cast("bigint")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(ident.alias("doc_id"), F.coalesce(crc_mod(ident, 4) == 2, F.lit(False)).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letter"))
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double")
