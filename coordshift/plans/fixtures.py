"""Inputs derived from the test tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels")

BLOCKS = """SELECT CAST(o_custkey % 5 AS BIGINT) * 2 + o_orderkey % 2 AS chain_id, o_orderkey AS line_no,
 concat('c', CAST(o_custkey % 5 AS STRING)) AS s_name, CAST(200000000 AS BIGINT) AS s_len, CAST(100 + (o_orderkey % 2) * 50000000 AS BIGINT) AS s_start,
 concat('d', CAST((o_custkey + o_orderkey % 2) % 5 AS STRING)) AS d_name, CAST(200000000 AS BIGINT) AS d_len, CAST(500 + (o_orderkey % 2) * 50000000 AS BIGINT) AS d_start,
 (o_custkey % 5 + o_orderkey % 2) % 3 <> 0 AS strand, CAST(20 + o_orderkey % 90 AS BIGINT) AS len, CAST(o_orderkey % 7 AS BIGINT) AS ds, CAST((o_orderkey * 3) % 11 AS BIGINT) AS dd FROM orders"""

POINTS = """SELECT event_id AS point_id, concat('c', CAST(user_id % 6 AS STRING)) AS contig,
 CAST((event_id * 7919) % 120000 + CASE WHEN event_id % 3 = 0 THEN 50000000 ELSE 0 END AS BIGINT) AS pos FROM events"""

BED = """SELECT l_orderkey, l_linenumber, l_partkey, concat('c', CAST(l_suppkey % 6 AS STRING)) AS contig,
 CAST((l_orderkey * 131 + l_linenumber * 17) % 120000 AS BIGINT) AS bed_start,
 CAST((l_orderkey * 131 + l_linenumber * 17) % 120000 + 1 + l_partkey % 200 AS BIGINT) AS bed_end FROM lineitem"""

MASK = """SELECT p_partkey AS id, concat('c', CAST(p_partkey % 5 AS STRING)) AS contig, CAST((p_partkey * 53) % 120000 AS BIGINT) AS start,
 CAST((p_partkey * 53) % 120000 + p_size AS BIGINT) AS "end" FROM part"""

REGIONS = """SELECT event_id AS id, concat('c', CAST(user_id % 6 AS STRING)) AS contig, CAST((event_id * 7919) % 120000 AS BIGINT) AS start,
 CAST((event_id * 7919) % 120000 + 5 + event_id % 40 AS BIGINT) AS "end" FROM events"""

ALN = """SELECT concat('r', CAST(o_orderkey AS STRING)) AS qname,
 CAST(1 + CASE WHEN o_orderkey % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 32 ELSE 0 END
 + CASE WHEN o_orderkey % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN o_orderkey % 13 = 0 THEN 8 ELSE 0 END + CASE WHEN o_orderkey % 17 = 0 THEN 256 ELSE 0 END
 + CASE WHEN o_orderkey % 19 = 0 THEN 1024 ELSE 0 END AS INT) AS flag,
 concat('c', CAST(o_custkey % 6 AS STRING)) AS rname, CAST((o_orderkey * 7919) % 120000 AS BIGINT) AS pos, CAST(o_orderkey % 61 AS INT) AS mapq,
 CASE o_orderkey % 5 WHEN 0 THEN '100M' WHEN 1 THEN '5S95M' WHEN 2 THEN '40M2I58M' WHEN 3 THEN '50M3D50M' ELSE '60=1X30=9S' END AS cigar,
 CAST((o_orderkey * 7919 + o_orderkey % 500) % 120000 AS BIGINT) AS pnext, CAST(o_orderkey % 1400 - 700 AS BIGINT) AS tlen,
 CAST(100 AS INT) AS l_qseq, CAST(o_orderkey % 12 AS INT) AS nm, CAST(o_orderkey % 200 AS INT) AS as_score, o_orderkey AS id FROM orders"""

RECON = """SELECT concat('r', CAST(a.o_orderkey AS STRING)) AS qname, b.label, CAST(s.segment AS INT) AS segment,
 CAST(CASE WHEN (a.o_orderkey * b.k + s.segment) % 23 = 0 THEN 4 ELSE 0 END AS INT) AS flag, CAST((a.o_orderkey * b.k) % 61 AS INT) AS mapq,
 CAST((a.o_orderkey * b.k) % 7 AS INT) AS nm, CAST((a.o_orderkey * b.k) % 9 - 4 AS BIGINT) AS tlen
 FROM orders a CROSS JOIN (SELECT 'source' AS label, 3 AS k UNION ALL SELECT 'target' AS label, 5 AS k) b CROSS JOIN (SELECT 1 AS segment UNION ALL SELECT 2 AS segment) s"""

SEQ = """SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '' /*g*/)),
 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACNACGTACGTACG') AS seq FROM documents"""

INTERVALS = f"""WITH b AS ({BLOCKS}), r AS (SELECT *, coalesce(sum(len + ds) OVER w, 0) AS cs, coalesce(sum(len + dd) OVER w, 0) AS cd FROM b
 WINDOW w AS (PARTITION BY chain_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT s_name AS contig, s_len, d_name AS target, strand, CAST(s_start + cs AS BIGINT) AS source_start, CAST(s_start + cs + len AS BIGINT) AS source_end,
 CAST(CASE WHEN strand THEN (d_start + cd) - (s_start + cs) ELSE (d_len - d_start - cd - len) - (s_start + cs) END AS BIGINT) AS off FROM r"""

INDEX = f"""WITH v AS ({INTERVALS}) SELECT *, CAST(row_number() OVER (PARTITION BY contig ORDER BY source_start) - 1 AS BIGINT) AS idx FROM v"""


def duck(sql: str) -> str:
    return sql.replace("'' /*g*/", "'', 'g'")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a fixture, its table names bound to the files of ``sf_dir``."""
    import re

    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    text = sql.replace("{", "{{").replace("}", "}}").replace('"end"', "`end`")
    for t in used:
        text = re.sub(rf"(?<=FROM )\b{t}\b", "{" + t + "}", text)
    return spark.sql(text, **frames)
