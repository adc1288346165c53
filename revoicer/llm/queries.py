"""Queries of this subpackage: one ``opN_<name>`` for each operator, whole tables in, full results out."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import class_lm, nearest, neardup, packing, quality, quality_sql, sentencepieces, sharding, toxicity, url_filter, warc
from .shared import table


def vocabulary(name: str) -> str:
    """The text of a public vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_pattern_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_bag_minhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_feistel_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op4_divergence_rules(spark, sf_dir):
    rows = quality.assess(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op5_piece_lattice(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return sentencepieces.encode(table(spark, sf_dir, "documents"), model, with_ids=False)


def op6_brown_class_lm(spark, sf_dir):
    return class_lm.score(table(spark, sf_dir, "documents"))


def op7_dated_url_lists(spark, sf_dir):
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op8_warc_capture_index(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_one_bit_codes(spark, sf_dir):
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op10_toxicity_bigru(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pattern_packing, op2_bag_minhash, op3_feistel_sharding, op4_divergence_rules, op5_piece_lattice, op6_brown_class_lm, op7_dated_url_lists, op8_warc_capture_index, op9_one_bit_codes, op10_toxicity_bigru)}

#: Every pair of texts that share a shingle, then the least id that links reach.
NEAR_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), u AS (SELECT row_number() OVER (ORDER BY min(doc_id)) AS k, t, min(doc_id) AS rep FROM d GROUP BY t),
 w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM u),
 s AS (SELECT k, x, count(*) AS n FROM (SELECT k, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w) GROUP BY ALL),
 z AS (SELECT k, sum(n) AS total FROM s GROUP BY k),
 p AS (SELECT a.k AS a, b.k AS b, sum(least(a.n, b.n)) AS c FROM s a JOIN s b ON a.x = b.x AND a.k < b.k GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN z za ON a = za.k JOIN z zb ON b = zb.k WHERE c >= 0.8 * (za.total + zb.total - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(k, m) AS (SELECT k, k FROM u UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.k WHERE r.m < e.b),
 c AS (SELECT k, min(m) AS m FROM r GROUP BY k)
 SELECT d.doc_id, o.rep AS class_id FROM d JOIN u ON d.t = u.t JOIN c ON c.k = u.k JOIN u o ON o.k = c.m"""

WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS newest FROM p GROUP BY h)
 SELECT page_id, url, strlen(p.h)::BIGINT AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(p.h), (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
 CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM p JOIN g ON p.h = g.h"""

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_bag_minhash": NEAR_SQL,
    "op4_divergence_rules": quality_sql.assess_sql(),
    "op7_dated_url_lists": url_filter.JUDGE_SQL,
    "op8_warc_capture_index": WARC_SQL,
}
