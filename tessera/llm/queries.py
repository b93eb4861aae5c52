"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_order_minhash(spark, sf_dir):
    from tessera.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op4_packed_matrices(spark, sf_dir):
    from tessera.llm.packing import packed_matrices

    return packed_matrices(table(spark, sf_dir, "documents"))


@query
def op5_best_fit(spark, sf_dir):
    from tessera.llm.packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark, sf_dir):
    from tessera.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), short_repeats=True)


ORACLES["op9_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
words AS (SELECT doc_id, line_no, line, string_split(line, ' ') AS w FROM lines WHERE line <> ''),
every AS (SELECT line, any_value(w) AS w, len(any_value(w)) AS n, min((doc_id, line_no)) AS first FROM words GROUP BY line),
d AS (SELECT * FROM every WHERE n >= 5),
pairs AS (
  SELECT a.line, a.w AS aw, a.n AS an, b.w AS bw, b.n AS bn, b.first FROM d a JOIN d b ON a.w[1] = b.w[1] AND abs(a.n - b.n) <= 1 AND b.first < a.first
  UNION ALL
  SELECT a.line, a.w, a.n, b.w, b.n, b.first FROM d a JOIN d b ON a.w[-1] = b.w[-1] AND a.w[1] <> b.w[1] AND abs(a.n - b.n) <= 1 AND b.first < a.first),
measured AS (
  SELECT line, first, an, bn,
    coalesce(list_position(list_transform(range(1, least(an, bn) + 1), lambda i: aw[i] = bw[i]), false) - 1, least(an, bn)) AS head,
    coalesce(list_position(list_transform(range(1, least(an, bn) + 1), lambda i: aw[an + 1 - i] = bw[bn + 1 - i]), false) - 1, least(an, bn)) AS tail
  FROM pairs),
near AS (SELECT line, min(first) AS near FROM measured
  WHERE (CASE WHEN head < 0 THEN least(an, bn) ELSE head END) + (CASE WHEN tail < 0 THEN least(an, bn) ELSE tail END) >= greatest(an, bn) - 1 GROUP BY line),
gone AS (
  SELECT w.doc_id, list(w.line_no ORDER BY w.line_no) AS dropped FROM words w JOIN every d USING (line) LEFT JOIN near USING (line)
  WHERE (w.doc_id, w.line_no) > d.first OR (near.near IS NOT NULL AND (w.doc_id, w.line_no) > near.near) GROUP BY w.doc_id)
SELECT t.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n_lines,
  CAST(coalesce(len(dropped), 0) AS INTEGER) AS n_dropped, coalesce(CAST(dropped AS INTEGER[]), []) AS dropped
FROM documents t LEFT JOIN gone USING (doc_id)
"""


@query
def op1_mix(spark, sf_dir):
    from tessera.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark, sf_dir):
    from tessera.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_warc(spark, sf_dir):
    from tessera.llm.warc import warc_report

    return warc_report(table(spark, sf_dir, "pages"))


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first, count(*) AS copies FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN copies > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN copies > 1 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""


@query
def op8_pii(spark, sf_dir):
    from tessera.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


@query
def op2_audio(spark, sf_dir):
    from tessera.llm.audio import media_report

    return media_report(table(spark, sf_dir, "documents"))


@query
def op10_nearest(spark, sf_dir):
    from pyspark.sql import functions as F

    from tessera.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op13_word_runs(spark, sf_dir):
    from tessera.llm.runs import run_report

    return run_report(table(spark, sf_dir, "documents"))


ORACLES["op13_word_runs"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS h
  FROM documents),
n AS (SELECT doc_id, h, h // 10 AS g, len(w) AS n FROM d),
rule AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM n),
raw AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
words AS MATERIALIZED (SELECT r.doc_id, r.i, s.word FROM raw r JOIN rule USING (doc_id)
  JOIN raw s ON s.doc_id = r.doc_id AND s.i = CASE WHEN r.i >= a THEN a + (r.i - a) % p ELSE r.i END),
places AS (SELECT doc_id, q, unnest(range(0, n - 2 * q, q)) AS i FROM (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM rule WHERE n >= 6)),
likely AS (SELECT DISTINCT x.doc_id, q FROM places x JOIN words a ON a.doc_id = x.doc_id AND a.i = x.i
  JOIN words b ON b.doc_id = x.doc_id AND b.i = x.i + q AND b.word = a.word JOIN words c ON c.doc_id = x.doc_id AND c.i = x.i + 2 * q AND c.word = a.word),
equal AS (SELECT l.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY l.doc_id, q ORDER BY a.i) AS island
  FROM likely l JOIN words a ON a.doc_id = l.doc_id JOIN words b ON b.doc_id = l.doc_id AND b.i = a.i + q AND b.word = a.word),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
per AS (SELECT doc_id, count(*) AS n_runs, max((length, -start, -period)) AS x, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM (SELECT * FROM words ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -x[2] AS start, x[1] AS length, -x[3] AS period, CAST(floor(1000 * x[1] / -x[3]) AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op11_spotsigs(spark, sf_dir):
    from tessera.llm.spotsigs import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from tessera.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
