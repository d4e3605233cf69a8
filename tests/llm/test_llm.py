"""Edge cases and brute-force comparisons of the training-data operators."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, langid, minhash, packing, quality, radix, suffixes, toxicity, warc
from corvane.llm.common import slices, small

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, id string, key string"


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash", "clash") for i, t in zip(ids, texts, strict=True)], DOCS)


LONG = "lorem ipsum " * 20_000
ODD = ["", None, "a", "A", "a", "  \n\t ", "éÉ", LONG, LONG, LONG.upper()]


def brute_base(s):
    s = s or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cov = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(cov)


def test_quality(spark):
    rng = random.Random(1)
    texts = [*ODD, *("\n".join(" ".join(rng.choice("ab cd ef #x y|z".split()) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))) for _ in range(60))]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in quality.quality_rules(d, spark.createDataFrame([(10,), (11,), (None,)], "doc_id bigint")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, e = got[i], brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and not (r.base_failed and r.kept)
    assert quality.keep_quality(d, spark.createDataFrame([], "doc_id bigint")).columns == d.columns
    assert quality.quality_rules(d.limit(0), spark.createDataFrame([], "doc_id bigint")).count() == 0


def test_quality_ratio(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice("sun moon star sky".split()) + str(rng.randint(0, 40)) for _ in range(80)) for _ in range(30)]
    junk = [" ".join(rng.choice("xx qq zz".split()) + str(rng.randint(0, 60)) for _ in range(80)) for _ in range(30)]
    r = quality.quality_rules(docs(spark, good + junk), spark.createDataFrame([(i,) for i in range(30)], "doc_id bigint")).collect()
    assert all(x.kept == (x.doc_id < 30) for x in r if not x.base_failed) and sum(not x.base_failed for x in r) > 50


def brute_buckets(text):
    """Spark's xxhash64 of words and of pairs (of the hash, the next, the first plus one), in plain Python."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]

    def chained(*xs):
        seed = 42
        for x in xs:
            seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x) % quality.BUCKETS for x in h] + [signed(chained(a, b, a + 1)) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]


def test_quality_verdict_brute_force(spark):
    rng = random.Random(12)
    texts = [*ODD, *(" ".join(rng.choice("sun moon star sky é漢 xx qq zz".split()) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 120))) for _ in range(60))]
    good = [i for i in range(10, 40)]
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(brute_buckets(t))
        if i in good:
            target.update(brute_buckets(t))
    n, m = sum(raw.values()), sum(target.values())
    weight = [round(1e6 * (math.log((target[b] + 1) / (m + quality.BUCKETS)) - math.log((raw[b] + 1) / (n + quality.BUCKETS)))) for b in range(quality.BUCKETS)]
    rows = quality.quality_rules(docs(spark, texts), spark.createDataFrame([(i,) for i in good], "doc_id bigint")).collect()
    for r in rows:
        b = brute_buckets(texts[r.doc_id])
        total = sum(weight[x] for x in b)
        assert r.ratio == int(total / max(len(b), 1)) and r.kept == (not r.base_failed and total >= quality.LEAST * len(b))
    assert {r.kept for r in rows} == {True, False}


def lower(t):
    return (t or "").encode().translate(bytes.maketrans(radix.UPPER.encode(), radix.LOWER.encode()))


def test_exact_dedup(spark):
    rng = random.Random(3)
    texts = [*ODD, *("x" * 63, "x" * 64, "x" * 65, "x" * 64, "X" * 65), *("p" * 600 + rng.choice("abc") for _ in range(40)), *["hot copy"] * 30]
    d = docs(spark, texts)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    got = {r.doc_id: tuple(r)[1:] for r in radix.exact_dedup(d).collect()}
    assert got == {i: (max(m), len(m), i == max(m), hashlib.sha256(k).hexdigest()) for k, m in groups.items() for i in m}
    kept = radix.keep_exact(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(m) for m in groups.values())
    assert radix.exact_dedup(d.limit(0)).count() == 0


def test_small(spark):
    d = spark.createDataFrame([(b"x" * 600,)] * 3, "digit binary")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(d, 3)) and hinted(small(d, 3, F.length("digit"))) and hinted(small(d.limit(0), 0, F.length("digit"), 0))
    assert not hinted(small(d, 2)) and not hinted(small(d, 3, F.length("digit"), 1799))


def test_exact_dedup_repeated_ids(spark):
    d = docs(spark, ["a", "a", "a", "b", "b"], [1, 1, None, None, 7])
    rows = radix.exact_dedup(d).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2 and radix.keep_exact(d).count() == 2


@pytest.fixture(scope="module")
def vocab():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def test_bpe_against_tiktoken(spark, vocab):
    import tiktoken

    with open(vocab[0], "rb") as f:
        ranks = bpe.read_ranks(f.read())
    enc = tiktoken.Encoding("own", pat_str=vocab[1], mergeable_ranks=ranks, special_tokens={})
    tok, rng = bpe.ByteBPE(ranks, vocab[1]), random.Random(4)
    tok.words.transducer.MAX_STATES, tok.words.transducer.LOOK = 50, 4  # starts afresh, within words too
    for _ in range(800):
        s = "".join(rng.choice("ab \n\t  éñ漢字🙂0123!!??,. 　thingers") for _ in range(rng.randint(0, 60)))
        assert tok.encode(s) == enc.encode_ordinary(s)
        assert "".join(tok.decode_stream(tok.encode(s), 1)) == s
        word = s.replace(" ", "").encode()
        assert word in ranks or tuple(tok.words.transducer.stream([word[i : i + 3] for i in range(0, len(word), 3)])) == tok.words.transducer.run(word)
    got = {r.doc_id: r for r in bpe.round_trips(docs(spark, ODD), *vocab).collect()}
    for i, t in enumerate(ODD):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode_documents(docs(spark, ["the end"]), *vocab).first().ids == enc.encode_ordinary("the end")
    assert bpe.round_trips(docs(spark, []), *vocab).count() == 0


def test_utf8_stream():
    s = bpe.Utf8Stream()
    data = "aé漢🙂z".encode() + b"\xff\xe6\xbc"
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.finish() == data.decode("utf-8", "replace")


def test_toxicity(spark):
    rng = random.Random(5)
    texts, rows = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice("sun moon tree lake road hill".split()) for _ in range(40)]
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["vilething", "rotten"])
        texts.append(" ".join(words))
        rows.append((i, int(bad)))
    lab = spark.createDataFrame(rows + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    d = docs(spark, [*texts, None, "", LONG, "you v1lething"])
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and len(got) == 404
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity.toxicity(d, lab.limit(0)).count() == 404


def test_toxicity_scores_brute_force():
    rng = np.random.default_rng(3)
    x = rng.random((300, len(toxicity.FEATURES)))
    y = (x[:, 1] + 0.2 * rng.random(300) > 0.6).astype(int)
    model = toxicity.fit_trees(x, y, {}, np.arange(300) % 5 == 0)
    assert len(model.trees) == toxicity.ROUNDS
    for row, score in zip(x[:40], model.scores(x[:40]), strict=True):
        margin = model.base
        for feature, cut, value in model.trees:
            node = 0
            while node < 2**toxicity.DEPTH - 1:
                f = feature[node]
                node = 2 * node + (2 if sum(e <= row[f] for e in model.edges[f]) > cut[node] else 1)
            margin += value[node - (2**toxicity.DEPTH - 1)]
        at, to = list(model.at), list(model.to)
        if margin <= at[0] or margin >= at[-1]:
            want = to[0] if margin <= at[0] else to[-1]
        else:
            k = next(i for i in range(len(at) - 1) if at[i] <= margin <= at[i + 1] and at[i] < at[i + 1])
            want = to[k] + (to[k + 1] - to[k]) * (margin - at[k]) / (at[k + 1] - at[k])
        assert score == pytest.approx(min(max(want, 0), 1), abs=1e-9)


def test_isotonic_rises():
    at, to = toxicity.isotonic(np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(to) >= 0).all() and (np.diff(at) >= 0).all()


def test_gru_gradient():
    net = langid.new_network(["a", "b"], 1)
    for name in ("out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    for name in ("e", "u", "b"):
        setattr(net, name, [p.astype(np.float64) for p in getattr(net, name)])
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (5, 7)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    mask = np.ones((5, 7))
    mask[0, 4:] = 0
    _, grads = langid.gradients(net, x, mask, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was, step = p[at], 1e-5
        p[at] = was + step
        up, _ = langid.gradients(net, x, mask, y)
        p[at] = was - step
        down, _ = langid.gradients(net, x, mask, y)
        p[at] = was
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3)


def test_language_pooling_brute_force():
    """A document's probabilities are the means over its bytes, each from its segment alone."""
    net = langid.new_network(["a", "b", "c"], 2)
    texts = [b"hello you", b"", bytes(range(97, 123)) * 20, "é漢".encode() * 70]
    got = langid.pooled(net, texts)
    for data, p in zip(texts, got, strict=True):
        each = []
        for k in range(0, len(data), langid.SEGMENT):
            piece = np.frombuffer(data[k : k + langid.SEGMENT], np.uint8)
            each += list(net.probabilities(np.concatenate([piece, np.zeros(langid.SEGMENT - len(piece), np.uint8)])[None, :])[: len(piece), 0])
        assert not data or np.allclose(np.mean(each, axis=0), p, atol=1e-5)
        assert p.sum() == pytest.approx(1.0 if data else 0.0, abs=1e-5)


def test_language_id(spark):
    rng = random.Random(6)
    langs = {"xx": "ka ke ki ko".split(), "yy": "zun zar zil".split()}
    rows = [(i, " ".join(rng.choice(langs[lang]) for _ in range(60)), lang) for i, lang in enumerate(rng.choice(list(langs)) for _ in range(160))]
    d = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 !!", "yy"), (902, "", None), (903, "ka ki " * 9000, None), (None, "zun", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "xx", "yy"]
    assert langid.identify(d.limit(0)).count() == 0 and langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_a_rare_language_is_learned(spark):
    rng = random.Random(9)
    words = {"xx": "ka ke ki ko".split(), "yy": "zun zar zil".split()}
    langs = ["xx"] * 3000 + ["yy"] * 20
    d = spark.createDataFrame([(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i, x in enumerate(langs)], "doc_id bigint, text string, lang string")
    got = langid.identify(d).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.99 and all(r.lang_pred == "yy" for r in got if langs[r.doc_id] == "yy")


def test_language_accuracy_on_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(d).filter("held_out").join(d.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_slices_hold_few_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (5, 5, None, 50, 1, 0, 9)])], names=["t"])
    assert [s.column(0).to_pylist() for s in slices(batch, 0, rows=3, size=10)] == [["a" * 5, "a" * 5, None], ["a" * 50], ["a", "", "a" * 9]]


def brute_components(texts, size=4):
    """(set size, smallest place reachable) of each text, from sets of word tuples."""
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans(radix.UPPER, radix.LOWER)) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(rng, families=12, copies=12, edits=2, words=60):
    base = [[rng.choice("abcdefghijklmnop") * 2 + str(rng.randint(0, 99)) for _ in range(rng.randint(3, words))] for _ in range(families)]
    texts = [None, "", " ", "one", "ONE", "one two", "é\u00a0x y z w"]
    for b in base:
        for _ in range(copies):
            w = list(b)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
            texts.append(" ".join(w))
    return texts


def test_near_dedup_brute_force(spark):
    texts = near_texts(random.Random(7))
    d = docs(spark, texts)
    want = brute_components(texts)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_groups(d).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(want)}
    kept = minhash.keep_near(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in enumerate(want) if c == i]
    assert minhash.near_groups(d.limit(0)).count() == 0 and minhash.keep_near(d.limit(0)).count() == 0


def test_near_dedup_of_crowded_regions_in_blocks(spark, monkeypatch):
    """Families of more rows than a block, regions of more rows than meet: descent, further orders, deals and block pairs."""
    for name, value in (("CROWD", 4), ("ROWS", 5)):
        monkeypatch.setattr(minhash, name, value)
    texts = near_texts(random.Random(13), 3, 40, 5, 60)
    want = brute_components(texts)
    assert len({c for _, c in want}) > 20
    got = {r.doc_id: r.component_id for r in minhash.near_groups(docs(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(want)}


def test_near_dedup_of_rows_that_repeat(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    texts = ["a b c d e f", "a b c d e f", "A b c d e f", long, long + " x", None, None, "q r s t", "q r s t", "q r s t u"]
    ids = [1, 1, 2, None, 4, 9, 9, None, None, None]
    d = docs(spark, texts, ids).withColumnRenamed("key", "_id").withColumn("_xh", F.lit(1))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_groups(d).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (0, 4, False), (4, 4, True), (9, 9, True), (9, 9, True), (0, 0, True), (0, 0, True), (0, 0, True)])
    kept = minhash.keep_near(d).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, "a b c d e f"), (4, long + " x"), (9, ""), (9, ""), (0, "q r s t"), (0, "q r s t u")])


def test_near_dedup_recall_on_documents(spark):
    """All links of sf0.01's documents against exact pairs by an inverted index: recall of components' pairs is 1 here."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(str.maketrans(radix.UPPER, radix.LOWER)))
        n = min(4, len(w))
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    by, shared = {}, Counter()
    for i, s in sets.items():
        for x in s:
            for j in by.setdefault(x, []):
                shared[j, i] += 1
            by[x].append(i)
    links = [(i, j) for (i, j), c in shared.items() if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    comp = {r.doc_id: r.component_id for r in minhash.near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(links) > 50 and sum(comp[i] == comp[j] for i, j in links) >= 0.99 * len(links)


def test_linked_with_sides():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [7, 8], [7, 8], [1, 2, 3, 4, 5])]
    group = np.array([10, 11, 12, 13, 10])
    assert minhash.linked(sets, group) == [(1, 0), (3, 2)]
    assert minhash.linked(sets, group, np.array([0, 0, 0, 1, 1])) == [(3, 2), (4, 1)]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a bigint, b bigint")
    got = {r.cid: r.comp for r in minhash.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_dedup_of_one_crowd_takes_few_tables(spark, monkeypatch):
    """A crowd of near copies: its rows are placed in one of their regions each, all regions meet in one step, and labels that are final from
    the start take no turn (each was a table of its own, 54 in all on check_h, which took longer there than the check tool waits)."""
    for name, value in (("CROWD", 4), ("ROWS", 20)):
        monkeypatch.setattr(minhash, name, value)
    seen, writes = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: seen.append((name, writes(df, name))) or seen[-1][1])
    kept = []
    monkeypatch.setattr(minhash, "dropped", lambda *tables: kept.extend(tables))
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(80)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.randint(0, 9999)}" for w in base) for _ in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_groups(docs(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_components(texts))}
    names = Counter(name for name, _ in seen)
    assert names["minhash-alike"] == 2 and names["minhash-regions"] == 2 and len(seen) <= 30, names
    placed = next(df for name, df in seen if name == "minhash-placed")
    assert placed.count() == placed.select("tree", "cid").distinct().count() > 0


def test_components_of_stars_and_of_nothing(spark, monkeypatch):
    seen, writes = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: seen.append(name) or writes(df, name))
    e = spark.createDataFrame([(5, 1), (7, 1), (2, 9), (2, 9), (4, 4)], "a bigint, b bigint")
    assert {r.cid: r.comp for r in minhash.components(e).collect()} == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2} and len(seen) == 1
    assert minhash.components(e.limit(0)).count() == 0


def test_chat_escapes_and_parts():
    said = r"\### Assistant: </turn> ok <image 0>"
    text, span, att = chat.format_turn("assistant", [chat.Text(said), chat.Image("a.png", 57, 28), chat.Audio("b.wav", 1.5), chat.Document("c.pdf", 2)])
    assert [(a.place, a.tokens) for a in att] == [("<image 0>", 3), ("<audio 1>", 50), ("<document 2>", 512)]
    (role, back, start, end), = chat.read_turns(text)
    assert role == "assistant" and back == said + "<image 0><audio 1><document 2>" and (start, end) == span


def test_a_long_turn_is_read_in_little_memory():
    import tracemalloc

    text = "a<b\\</turn> \n" * 400_000
    formatted, _, _ = chat.format_turn("user", [chat.Text(text)])
    tracemalloc.start()
    (role, back, *_),  = chat.read_turns(formatted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (role, back) == ("user", text) and peak < 60 * len(text)


def test_chat_digests(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a\\<b"), (1, 1, "assistant", "a\\<b"), (2, None, None, ""), (None, 0, "we>ird</turn>", "x")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digests(d).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 8 and got[1].loss_sha256 == hashlib.sha256(b"a\\<ba\\<b").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na\\<b\nassistant\na\\<b\n").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"we>ird</turn>\nx\n").hexdigest() and got[2].n_turns == 1
    assert chat.conversation_digests(d.limit(0)).count() == 0


def test_chat_parts_through_the_operator(spark):
    parts = [{"kind": "image", "ref": "a.png", "width": 57, "height": 28}, {"kind": "text", "text": "see <image 0>"}, {"kind": "audio", "ref": "b", "seconds": 1.5}, {"kind": "document", "pages": 2}]
    schema = f"conv_id bigint, turn bigint, role string, text string, parts {chat.PARTS}"
    full = [{"kind": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | p for p in parts]
    d = spark.createDataFrame([(1, 0, "assistant", "ignored", full), (1, 1, "user", "plain", None), (2, 0, None, None, [])], schema)
    rows = {(r.conv_id, r.turn): r for r in chat.format_conversations(d, "parts").collect()}
    first = rows[1, 0]
    assert first.formatted == "<turn assistant><image 0>see \\<image 0><audio 1><document 2></turn>\n"
    assert [(a.place, a.ref, a.tokens) for a in first.attachments] == [("<image 0>", "a.png", 3), ("<audio 1>", "b", 50), ("<document 2>", "", 512)]
    assert first.formatted[first.loss_start : first.loss_end].startswith("<image 0>") and rows[1, 1].attachments == [] and rows[2, 0].formatted == "<turn ></turn>\n"
    got = {r.conv_id: (r.n_attachments, r.attachment_tokens) for r in chat.conversation_digests(d, "parts").collect()}
    assert got == {1: (3, 565), 2: (0, 0)}


def brute_repeats(texts, window):
    data = [(t or "").encode() for t in texts]
    c = Counter(b[p : p + window] for b in data for p in range(len(b) - window + 1))
    out = {}
    for i, b in enumerate(data):
        m = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if c[b[p : p + window]] > 1:
                m[p : p + window] = b"\1" * window
        out[i] = (len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1])), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffixes_brute_force(spark, hot):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(n) for n in (30, 45, 80, 200)]
    texts = [None, "", "abc" * 40, "é" * 50] + ["".join(make(rng.randint(0, 90)) + rng.choice(passages) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    texts += texts[10:14]
    d = docs(spark, texts)
    rows = suffixes.repeats(d, window=40, gram=8, hot=hot).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == brute_repeats(texts, 40)
    assert all(len(r.kept_text.encode()) <= r.n_bytes - r.n_removed and (r.n_removed or r.kept_text == (texts[r.doc_id] or "")) for r in rows)
    if hot > 2:
        cut = suffixes.without_repeats(d, window=40, gram=8)
        assert cut.columns == d.columns and cut.count() == len(texts)
        assert suffixes.repeats(d.limit(0)).count() == 0


@pytest.mark.parametrize("nameless", [False, True])
def test_suffixes_of_rows_that_repeat(spark, nameless):
    """Rows that share an id (or null) and a text are sought through once: their number costs nothing but themselves."""
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(1000))
    d = spark.range(20_000).select(F.lit(None if nameless else 7).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    d = d.unionByName(docs(spark, ["z" + text[100:600] + "z", "short"], [1, 2]).select("doc_id", "text"))
    rows = suffixes.repeats(d).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in rows} == {(1000, 1000, 1, 20_000), (502, 500, 1, 1), (5, 0, 0, 1)}
    one = suffixes._once(suffixes._texts(d, "doc_id", "text"), [(400, 32, False)])
    assert one[0].count() == 3 and one[1].count() == 1


def test_suffixes_in_pieces(spark, monkeypatch):
    """Anchors of a text that is taken in pieces of 25 windows, against brute force."""
    rng = random.Random(18)
    make = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = make(150)
    texts = [make(rng.randint(0, 200)) + shared[: rng.randint(20, 150)] + make(30) for _ in range(30)]
    want = brute_repeats(texts, 40)
    monkeypatch.setattr(suffixes, "PIECE", 25)
    places = [suffixes.anchors(np.frombuffer(t.encode(), np.uint8), 40, 8) for t in texts]
    assert sum(len(p[0]) for p in places) > 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(range(30), pa.int64()), pa.array(texts)], names=["doc_id", "xh", "text"])
    covered = {}
    for out in suffixes._find([(40, 8, False)])(iter([batch])):
        for r in out.to_pylist():
            assert r["first"] <= r["place"] <= r["last"] + 32
            covered.setdefault(r["doc_id"], []).extend(range(r["first"], r["last"] + 1))
    assert all(sorted(covered[i]) == list(range(len(t) - 39)) for i, t in enumerate(texts))
    assert {r.doc_id: tuple(r)[1:5] for r in suffixes.repeats(docs(spark, texts), window=40, gram=8).collect()} == want


def test_suffixes_at_the_contract(spark):
    """400 bytes, against brute force, on whole documents; the least id of 64 bits and null are ids like any other."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.length("text")).limit(120).collect()
    texts = [r.text for r in rows] + ["q" * 399, "q" * 400, None]
    ids = [-(1 << 63), None, *range(2, len(texts))]
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.repeats(docs(spark, texts, ids)).collect()}
    assert got == {ids[i]: v for i, v in brute_repeats(texts, 400).items()}


def test_windows_of_equal_hash_are_told_apart_by_bytes(monkeypatch):
    records = [(b"abcdefgh", b"", False, 1, 0, 0), (b"xyabcdxy", b"", False, 2, 0, 0), (b"zzzzabcd", b"", True, 3, 0, 0)]
    want = sorted(suffixes.repeated_windows(records, 4))
    rng = random.Random(15)
    letters = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    many = [(b"anchor" + letters(14), letters(12), False, i, 0, 0) for i in range(200)]  # windows of 20 that start up to 12 before the anchor
    found = suffixes.repeated_windows(many, 20)
    whole = sorted((d, *x) for d in range(200) for x in suffixes.merged_spans([r[2:] for r in found if r[0] == d]))
    monkeypatch.setattr(suffixes, "AT_ONCE", 300)
    cut = suffixes.repeated_windows(many, 20)
    assert sorted((d, *x) for d in range(200) for x in suffixes.merged_spans([r[2:] for r in cut if r[0] == d])) == whole and len(whole) > 20
    monkeypatch.setattr(suffixes, "rolling", lambda b, width: np.zeros(max(len(b) - width + 1, 0), np.uint64))
    assert sorted(suffixes.repeated_windows(records, 4)) == want == [(1, 0, 0, 4), (2, 0, 2, 6)]


def test_pipeline_cuts_passages_of_51_words(spark):
    import corpus_pipeline

    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    p51, p50, p80, solid = words(51), words(50), words(80), "".join(words(100))
    own = [words(30) for _ in range(12)]
    mid = lambda i, p: " ".join([*own[i][:15], *p, *own[i][15:]])
    texts = [mid(0, p51), " ".join(own[1]) + "\n" + "\n ".join(p51), mid(2, p50), mid(3, p50), mid(4, p80), mid(5, [*p80, *p80]), mid(6, p80[:51]), mid(7, p80[:50]), mid(8, [solid]), mid(9, [solid]), " ".join(p51), None]
    assert len(" ".join(p51)) < 400
    d = docs(spark, texts).withColumn("_l", F.lit(1)).withColumn("rest", F.lit(2))
    for out in (corpus_pipeline.suffix_stage(spark, d, ""), suffixes.without_repeats(d, hot=1, passages=True)):
        got = {r.doc_id: r.text for r in out.collect()}
        for i in (0, 1, 6):
            assert got[i].split() == own[i]
        for i in (4, 5, 8, 9):  # 400 bytes and more: bytes beside them may be equal too
            assert 0 <= len("".join(own[i])) - len("".join(got[i].split())) < 6
        assert [got[i] for i in (2, 3, 7, 10, 11)] == [texts[2], texts[3], texts[7], "", None]


def test_spans_are_joined(spark):
    """A passage's spans, one for each anchor, are one span where they overlap or touch."""
    rows = [(1, 5, s, s + 40, w) for w in (False, True) for s in range(0, 400, 20)] + [(1, 5, 440, 480, False), (1, 6, 500, 600, False), (None, 5, 0, 9, True), (None, 5, 9, 12, True), (None, 5, 3, 5, True)]
    out = suffixes._joined(spark.createDataFrame(rows, "doc_id bigint, xh bigint, start int, stop int, words boolean"))
    got = {(r.doc_id, r.xh, r.words, r.start, r.stop) for r in out.collect()}
    assert got == {(1, 5, False, 0, 420), (1, 5, True, 0, 420), (1, 5, False, 440, 480), (1, 6, False, 500, 600), (None, 5, True, 0, 12)} and out.count() == 5


def test_op9_tells_passages_of_51_words(spark, tmp_path):
    """Passages of over 50 words with fewer than 400 bytes show in op9's further columns; those of its contract go by 400 bytes alone."""
    from corvane.llm.queries import op9_suffix_array_dedup

    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    p51, p50, p90, own = words(51), words(50), words(90), [words(30) for _ in range(8)]
    mid = lambda i, p: " ".join([*own[i][:15], *p, *own[i][15:]])
    twice, long = " ".join(words(55)), "x" * 400
    texts = [mid(0, p51), mid(1, p51), mid(2, p50), mid(3, p50), mid(4, p90), mid(5, p90), " ".join(own[6]), None, twice, twice, long, long]
    assert len(" ".join(p51)) + 2 < 400 and 255 < len(twice) < 400
    ids = [*range(8), 8, 8, None, None]  # the last four repeat an id and a text
    docs(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    out = op9_suffix_array_dedup(spark, str(tmp_path)).collect()
    assert len(out) == len(texts)
    got, want = {r.doc_id: r for r in out}, brute_repeats(texts, 400)
    assert all(tuple(got[i])[1:5] == want[n] for n, i in enumerate(ids))
    for i in (0, 1, 4, 5):
        assert got[i].n_passages == 1 and len(got[i].passage_free_text.encode()) == got[i].n_bytes - got[i].n_passage_bytes
    assert all(got[i].passage_free_text.split() == own[i] and got[i].n_removed == 0 for i in (0, 1))
    assert all((got[i].n_passage_bytes, got[i].n_passages, got[i].passage_free_text) == (0, 0, texts[i] or "") for i in (2, 3, 6, 7))
    assert all(got[i].n_passage_bytes >= got[i].n_removed > 400 for i in (4, 5))
    assert (got[8].n_removed, got[8].n_passage_bytes, got[8].passage_free_text) == (0, len(twice), "")
    assert (got[None].n_removed, got[None].n_passage_bytes, got[None].passage_free_text) == (400, 400, "")


def test_loser_tree():
    rng = random.Random(9)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12))) for _ in range(7)]
    coded = [suffixes.run_of(suffixes.front_coded([(t, b"", False, 0, 0, 0) for t in r])) for r in runs]
    out = [(n, t) for n, t, _ in suffixes.LoserTree(coded)]
    assert [t for _, t in out] == sorted(t for r in runs for t in r)
    assert all(n == suffixes.shared(a[1], b[1], 0) for a, b in zip(out, out[1:], strict=False) for n in [b[0]])


def test_warc(spark):
    big = "<p>é" * 400
    rows = [(1, "http://b.example.org/x?y#z", big), (2, "https://User@A.example.com:8080/", big), (3, "not a url", None), (4, None, ""), (5, "http://a.example.com/\r\nX: y", "small"), (6, "http://a.example.com/s", "small"), (None, "http://n.example.com/", big), (8, "http://a.example.com/", LONG)]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, digest string")
    got = {r.page_id: r for r in warc.warc_round_trip(d).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 2
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 2 if again else None)
    assert warc.warc_round_trip(d.limit(0)).count() == 0
    assert warc.surt("https://User@A.example.com:8080/p?q") == "com,example,a:8080)/p?q"
    assert gzip.decompress(warc.record("response", 1, "u", "d", 1, b"x", None)).startswith(b"WARC/1.1\r\n")


def test_packing(spark):
    rng = random.Random(10)
    texts = [None, "", "z" * 20_000, *("w" * rng.randint(1, 9000) for _ in range(200))]
    d = spark.createDataFrame([(i, t, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 7 else None, i % 50, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, c bigint, shard string")
    rows = packing.best_fit(d, cluster="c", shard_rows=64).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.doc_start, r.n_bytes))
        if r.bin >= 0:
            bins.setdefault((r.shard, r.bin), []).append(r)
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(t or "")
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.n_bytes
        assert at <= packing.CAPACITY and len({r.cluster for r in b}) == len(b)
        assert max(Counter(r.source for r in b if r.source).values(), default=0) <= packing.PER_SOURCE
    assert packing.best_fit(d.limit(0)).count() == 0


def test_packing_spreads_rows_that_repeat(spark):
    d = spark.createDataFrame([(None, "same", "s", "x")] * 2000 + [(7, "other", "s", "x")], "doc_id bigint, text string, source string, _cluster string")
    rows = packing.best_fit(d, shard_rows=100, cluster=packing.cluster_of()).collect()
    assert len(rows) == 2001 and max(Counter(r.shard for r in rows).values()) < 200


def test_best_fit_brute_force():
    """Against a plain search of all bins: the tightest compatible one, of equal ones the oldest."""
    rng = random.Random(14)
    items = [(i, rng.randint(0, 260), rng.choice("abc") if i % 5 else None, rng.randint(0, 30) if i % 3 else None) for i in range(300)]
    out, rest, bins, solo = [], [], [], 0
    for key, size, source, cluster in items:
        at = 0
        while size - at >= 100:
            out.append((key, solo, at, 0, 100))
            solo, at = solo + 1, at + 100
        if size > at:
            rest.append((size - at, key, at, source, cluster))
        elif not size:
            out.append((key, -1, 0, 0, 0))
    for size, key, at, source, cluster in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = [(100 - sum(y[0] for y in b), k) for k, b in enumerate(bins) if sum(y[0] for y in b) + size <= 100 and (source is None or sum(y[1] == source for y in b) < 2) and (cluster is None or all(y[2] != cluster for y in b))]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([])
        out.append((key, solo + k, at, sum(y[0] for y in bins[k]), size))
        bins[k].append((size, source, cluster))
    assert sorted(packing.pack_shard(items, 100, 2)) == sorted(out)


def test_packing_parts_copies_of_any_case(spark, tmp_path):
    import corpus_pipeline

    from corvane.llm import queries

    texts = ["Equal Rest", "equal rest", "EQUAL rest", "other"]
    d = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (corpus_pipeline.packing_stage(spark, d, ""), queries.op5_best_fit_packing(spark, str(tmp_path))):
        bins = {r.doc_id: (r.shard, r.bin) for r in out.collect()}
        assert len({bins[i] for i in range(3)}) == 3 and len(set(bins.values())) == 3


def test_best_fit_takes_the_tightest():
    out = packing.pack_shard([("a", 60, "s", None), ("b", 70, "t", None), ("c", 30, "u", None), ("d", 35, "v", 1)], 100, 2)
    where = {k: b for k, b, *_ in out}
    assert where["d"] == where["a"] and where["c"] == where["b"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cols, ids = d.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        if name != "best_fit_packing":
            assert out.columns == cols
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in d.select("doc_id").collect()}
        assert ids is None or now <= ids
        ids = now
    assert len(ids) > 100


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, kind):
    """Nulls in any column, empty and very long texts, repeated rows, names that operators use themselves."""
    import corpus_pipeline

    d = docs(spark, [*ODD, *ODD], [*range(len(ODD)), *([None] * 3), *range(3, len(ODD))])
    for name in ("_id", "_xh", "_l", "rid", "rest", "_cluster", "shard", "comp", "gid"):
        d = d.withColumn(name, F.lit(None).cast("string"))
    d = d.limit(0) if kind == "empty" else d
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path)).collect()
        assert (not out) if kind == "empty" else name == "quality_rules" or out, name
