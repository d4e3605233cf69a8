"""Interval overlap join, filter audit and subword embeddings against plain versions, on odd tables and repeated rows."""

import datetime
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import audit, embedded, intervals

EPOCH = datetime.datetime(1970, 1, 1)
FAR = 10**15


def us(t):
    return (t - EPOCH) // datetime.timedelta(microseconds=1)


def brute_overlaps(sales, lines, clicks):
    by = {}
    for client, ts, kind in clicks:
        if client is not None and ts is not None:
            by.setdefault(client, []).append((us(ts), kind == "error"))
    sessions = []
    for client, rows in by.items():
        rows.sort()
        runs = [[rows[0]]]
        for a, b in itertools.pairwise(rows):
            if b[0] - a[0] > 900_000_000:
                runs.append([])
            runs[-1].append(b)
        for run in runs:
            last = run[-1][0]
            sessions.append((client, run[0][0], run[0][0] // intervals.SLOT, FAR if any(bad for t, bad in run if t == last) else last // intervals.SLOT))
    out = Counter()
    slots, crcs = {}, Counter()
    for sale, client, status, sold in sales:
        if client is None or sold is None:
            continue
        first = us(sold)
        last = max([first, *(us(t) for s, t in lines if s is not None and s == sale and t is not None)])
        a, b = first // intervals.SLOT, FAR if status == "open" else last // intervals.SLOT
        for c, t, s, e in sessions:
            if c != client or max(a, s) > min(b, e):
                continue
            names = (("overlaps", "finished_by", "contains"), ("starts", "equals", "started_by"), ("during", "finishes", "overlapped_by"))
            name = names[(a >= s) + (a > s)][(b >= e) + (b > e)]
            out[sale, name] += 1
            crcs[sale, name] += zlib.crc32(str(t).encode())
            slots.setdefault((sale, name), []).append(None if min(b, e) == FAR else min(b, e) - max(a, s) + 1)
    return {(*k, n, None if None in slots[k] else sum(slots[k]), crcs[k]) for k, n in out.items()}


def shop(spark, sales, lines, clicks):
    return (
        spark.createDataFrame(sales, "sale_id bigint, client_id bigint, status string, sold_at timestamp_ntz"),
        spark.createDataFrame(lines, "sale_id bigint, shipped_at timestamp_ntz"),
        spark.createDataFrame([(c, t, k, "x", 1) for c, t, k in clicks], "client_id bigint, ts timestamp_ntz, kind string, client string, s int"),
    )


def got_overlaps(*tables):
    return {tuple(r) for r in intervals.overlaps(*tables).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_brute_force(spark, seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 3, 9)
    at = lambda days: start + datetime.timedelta(microseconds=rng.randrange(int(days * 86_400_000_000)))
    clicks = [(rng.choice([1, 1, 2, 3, None]), rng.choice([at(4), at(0.2), None]), rng.choice(["view", "error", None])) for _ in range(300)]
    clicks += [(1, start + datetime.timedelta(minutes=15 * k), "view") for k in range(400)]  # pauses of exactly GAP, over days and cells
    clicks += [(2, datetime.datetime(9999, 12, 31), "error"), (2, datetime.datetime(1969, 12, 31, 23, 59, 59, 999_999), "view"), (3, at(1), "error")] * 2
    sales = [(i, rng.choice([1, 2, 3, 4, None]), rng.choice(["open", "done", None]), rng.choice([at(5), at(0.3), None])) for i in range(80)] + [(900, 2, "done", datetime.datetime(1969, 1, 1))]
    lines = [(rng.choice([*range(80), 900, None]), rng.choice([at(6), None, datetime.datetime(9998, 1, 1)])) for _ in range(120)]
    assert got_overlaps(*shop(spark, sales, lines, clicks)) == brute_overlaps(sales, lines, clicks)


def test_overlaps_of_empty_tables_and_nameless_sales(spark):
    t = datetime.datetime(2024, 1, 1)
    assert got_overlaps(*shop(spark, [], [], [])) == set()
    assert got_overlaps(*shop(spark, [(1, 1, "open", t)], [], [])) == set()
    rows = intervals.overlaps(*shop(spark, [(None, 1, "done", t)] * 2, [(None, t + datetime.timedelta(days=9))], [(1, t, "view")])).collect()
    assert [(r.sale_id, r.relation, r.n_pairs, r.overlap_slots) for r in rows] == [(None, "equals", 1, 1)] * 2


def test_micros_ignore_the_session_zone(spark):
    d = spark.createDataFrame([(datetime.datetime(2024, 3, 10, 2, 30, 0, 123),), (datetime.datetime(1901, 1, 1, 0, 0, 0, 1),), (None,)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # has no 02:30 on that day
        assert [r[0] for r in d.select(intervals.micros(d, "ts")).collect()] == [us(datetime.datetime(2024, 3, 10, 2, 30, 0, 123)), us(datetime.datetime(1901, 1, 1, 0, 0, 0, 1)), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_one_client_with_everything_makes_no_more_pairs_than_slots(spark):
    """20,000 sales and 20,000 clicks of one client: classes, not rows, meet."""
    t = datetime.datetime(2024, 1, 1)
    s = spark.range(20_000).selectExpr("id AS sale_id", "1L AS client_id", "'open' AS status", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS sold_at")
    c = spark.range(20_000).selectExpr("1L AS client_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 20 * id, 0) AS ts", "'view' AS kind")
    lines = spark.createDataFrame([(1, t)], "sale_id bigint, shipped_at timestamp_ntz")
    rows = intervals.overlaps(s, lines, c).groupBy("relation").agg({"n_pairs": "sum", "sale_id": "count"}).collect()
    assert sum(r["sum(n_pairs)"] for r in rows) == 20_000 * 20_000  # all sales begin in the first slot and never end


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    failing = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        twin = any(i is not None and j is not None and j < i and (u or "") == text for j, u, _ in docs)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), twin)
        failing.append((i, lang or "", {x for x, bad in zip("ABCDE", tests, strict=True) if bad}))
    out = set()
    for part in {p for _, p, _ in failing}:
        mine = [(i, f) for i, p, f in failing if p == part]
        steps, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                steps.append(("".join(order), k + 1, len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x))
        out |= {(part, *s[:-1], shapley[s[-1]]) for s in steps}
    return out


def odd_docs():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = ["", None, "A B C", "same text", "same text", "#", "x" * 30_000, " ".join(words), " ".join(words[:199]), " ".join(words[:200]), " ".join(words[:100] * 3), "ÄÖ " * 250, ("Ab " * 250)]
    out = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(120)]
    return out + out[:10]


def test_audit_brute_force(spark):
    docs = odd_docs()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)]
    d = spark.createDataFrame([(i, t, p, "clash", 1) for i, t, p in docs], "doc_id bigint, text string, lang string, mask string, n int")
    x = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    assert {tuple(r) for r in audit.filter_audit(d, x).collect()} == brute_audit(docs, [(i, q, int(t)) for i, q, t in labels])
    assert audit.filter_audit(d.limit(0), x).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for k in audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_walk_updates_only_what_a_swap_changes():
    counts = np.random.default_rng(3).integers(0, 50, (32, 3))
    walk = audit.Walk(counts, 5)
    for k in audit.swaps(5):
        before = walk.steps.copy()
        walk.swap(k)
        fresh = audit.Walk(counts, 5)
        fresh.order = list(walk.order)
        for j in range(5):
            fresh._count(j)
        assert (fresh.steps == walk.steps).all()
        assert (np.delete(before, [k, k + 1], axis=0) == np.delete(walk.steps, [k, k + 1], axis=0)).all()


def plain_grams(text):
    """The n-grams by the words of the docstring: counts by kind and content."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = Counter({"end": 1})
    for w in words:
        out["word", w] += 1
        for k in embedded.GRAMS:
            b = f" {w} "
            out.update(("char", b[i : i + k]) for i in range(len(b) - k + 1))
    out.update("same" if a == b else ("pair", a, b) for a, b in itertools.pairwise(words))
    return out


def test_grams_are_those_of_the_plain_version():
    rng = random.Random(4)
    texts = ["", " ", "a", "ab ab", "é\tÉ\n\nx", "日本 語", *("".join(rng.choice("ab é\n\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(60))]
    bucket = {}
    for t in texts:
        plain, found = plain_grams(t), embedded.counts(t)
        assert sum(plain.values()) == found.sum()
        for kind in plain:  # equal contents fall into equal buckets: learned from texts that hold one word
            if isinstance(kind, tuple) and kind[0] == "word":
                bucket.setdefault(kind, set(np.flatnonzero(embedded.counts(kind[1]))))
                assert bucket[kind] <= set(np.flatnonzero(found))
        assert (found[embedded.SAME] == plain["same"]) and found[embedded.END] == 1


def test_scores_of_batches_and_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    net = embedded.Network(rng.normal(size=(embedded.BUCKETS, embedded.DIM)), rng.normal(size=(embedded.DIM, 2)), np.array([0.1, -0.2]))
    texts = ["", "one", "two words", "x" * 500, "many words " * 300, "", "end"]
    one = net.probabilities(np.stack([embedded.counts(t) for t in texts]))[:, 1]
    assert np.allclose(embedded.scores(texts, *net.table()), one)
    monkeypatch.setattr(embedded, "PIECE", 64)
    assert np.allclose(embedded.scores(texts, *net.table()), net.probabilities(np.stack([embedded.counts(t) for t in texts]))[:, 1])


def test_embedding_gradient():
    rng = np.random.default_rng(2)
    net = embedded.Network(rng.normal(size=(embedded.BUCKETS, embedded.DIM)), rng.normal(size=(embedded.DIM, 2)), rng.normal(size=2))
    ids, share = np.array([3, 7, 11]), np.array([0.5, 0.25, 0.25])
    _, d_mean, d_out, d_bias = embedded.gradients(net, ids, share, 1)

    def loss():
        return embedded.gradients(net, ids, share, 1)[0]

    for array, at, want in ((net.vectors, (7, 4), 0.25 * d_mean[4]), (net.out, (2, 1), d_out[2, 1]), (net.bias, (0,), d_bias[0])):
        array[at] += 1e-5
        up = loss()
        array[at] -= 2e-5
        down = loss()
        array[at] += 1e-5
        assert abs((up - down) / 2e-5 - want) < 1e-6


def test_quality_classifier_on_given_documents(spark):
    d, x = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = embedded.quality(d, x).join(x, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted for r in rows if r.quality]) > 0.97


def test_quality_classifier_on_odd_tables(spark):
    d = spark.createDataFrame([(1, "a", "k"), (1, "a", "k"), (None, None, "k"), (2, "", "k"), (3, "long " * 50_000, "k")], "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in embedded.quality(d, none).collect()} == {0.5}
    for q in (0, 1):
        assert {r.predicted for r in embedded.quality(d, spark.createDataFrame([(1, q), (2, q), (3, q)], "doc_id bigint, quality int")).collect()} == {q}
    both = embedded.quality(d, spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (1, None)], "doc_id bigint, quality int")).collect()
    assert len(both) == 5 and len({r.score for r in both if r.doc_id == 1}) == 1 and len({round(r.score, 12) for r in both if r.doc_id in (None, 2)}) == 1
    assert embedded.quality(d.limit(0), none).count() == 0
