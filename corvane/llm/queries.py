"""The queries opN_<name> and pipeline, and the SQL that DuckDB can hold some of them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship
from . import audit, bpe, chat, embedded, intervals, langid, minhash, packing, quality, radix, suffixes, toxicity, warc
from .common import table


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), quality.trusted_ids(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_dedup(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(ship(spark), sf_dir, "documents"), *vocabulary())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; documents with texts that op2 takes as equal are one duplicate cluster."""
    docs = table(ship(spark), sf_dir, "documents")
    return packing.best_fit(docs, cluster=packing.cluster_of())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(ship(spark), sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(ship(spark), sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ship(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    return chat.conversation_digests(rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By 400 bytes as the contract has it; what repeats of over 50 words take beside them follows in columns of its own."""
    return suffixes.repeats(table(ship(spark), sf_dir, "documents"), passages=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(ship(spark), sf_dir, "pages")).drop("url")


def op11_interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(*(table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded.quality(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_exact_dedup, op3_byte_bpe, op4_toxicity, op5_best_fit_packing, op6_language_id, op7_minhash_near_dedup, op8_chat_formatting, op9_suffix_array_dedup, op10_warc, op11_interval_overlap_join, op12_quality_classifier, op13_filter_audit)}

_NORMALISED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORMALISED} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op7_minhash_near_dedup": f"""
        WITH RECURSIVE
        w AS (SELECT doc_id, list_filter(string_split_regex({_NORMALISED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS ss FROM w),
        e AS (SELECT doc_id, unnest(ss) AS sh FROM s),
        n AS MATERIALIZED (SELECT doc_id, len(ss) AS n FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
        FROM n JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
        FROM q""",
    "op8_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn ></turn>') + 1 + length(role) + length(role) - length(translate(role, '\<>', ''))
                   + length(text) + length(text) - length(translate(text, '\<', '')))::BIGINT AS formatted_chars,
               0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
        FROM c GROUP BY conv_id""",
    "op11_interval_overlap_join": """
        WITH c AS (SELECT client_id AS k, epoch_us(ts) AS t, coalesce(kind = 'error', false) AS bad FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
        g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t) <= 900000000 THEN 0 ELSE 1 END AS fresh FROM c),
        h AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g),
        i AS (SELECT k, no, min(t) AS t1, max(t) AS t2 FROM h GROUP BY k, no),
        s AS (SELECT i.k, t1, t1 // 21600000000 AS a, CASE WHEN bool_or(bad AND h.t = t2) THEN 1000000000000 ELSE max(t2) // 21600000000 END AS b
              FROM i JOIN h ON h.k = i.k AND h.no = i.no GROUP BY i.k, i.no, t1),
        l AS (SELECT sale_id, max(shipped_at) AS m FROM sale_lines GROUP BY sale_id),
        v AS (SELECT s.sale_id, client_id AS k, epoch_us(sold_at) // 21600000000 AS c,
                     CASE WHEN status = 'open' THEN 1000000000000 ELSE epoch_us(greatest(sold_at, m)) // 21600000000 END AS d
              FROM sales s LEFT JOIN l ON l.sale_id = s.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
        f AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)) AS f),
        q AS (SELECT k, a, b, xor(list_reduce(list_transform(string_split(t1::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                                              lambda x, y: xor(x >> 8, f[(xor(x, y) & 255) + 1]), 4294967295), 4294967295) AS crc FROM s, f),
        p AS (SELECT sale_id, crc, greatest(a, c) AS lo, least(b, d) AS hi,
                     CASE WHEN c < a THEN CASE WHEN d < b THEN 'overlaps' WHEN d = b THEN 'finished_by' ELSE 'contains' END
                          WHEN c = a THEN CASE WHEN d < b THEN 'starts' WHEN d = b THEN 'equals' ELSE 'started_by' END
                          ELSE CASE WHEN d < b THEN 'during' WHEN d = b THEN 'finishes' ELSE 'overlapped_by' END END AS relation
              FROM q JOIN v USING (k) WHERE a <= d AND c <= b)
        SELECT sale_id, relation, count(*) AS n_pairs, sum(CASE WHEN hi < 1000000000000 THEN hi - lo + 1 END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
        FROM p GROUP BY sale_id, relation""",
    "op13_filter_audit": r"""
        WITH RECURSIVE
        d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        m AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
                     + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask,
                     coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic
              FROM w LEFT JOIN labels USING (doc_id)),
        c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        f AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM (SELECT unnest(range(5))::INT AS i)),
        p(o, before, bit, letter, step) AS (SELECT '', 0, 0, '', 0 UNION ALL SELECT o || f.letter, before | p.bit, f.bit, f.letter, step + 1 FROM p, f WHERE (before | p.bit) & f.bit = 0),
        s AS (SELECT a.o AS filter_order, b.before, b.bit, b.letter, b.step FROM p a JOIN p b ON a.step = 5 AND b.step > 0 AND starts_with(a.o, b.o)),
        r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
              FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r""",
    "op9_suffix_array_dedup": None,
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
