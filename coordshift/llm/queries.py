"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from coordshift.llm.bpe import op8_bpe
from coordshift.llm.contexttree import op3_contexttree
from coordshift.llm.digest import op7_digest
from coordshift.llm.kneserney import op6_kneserney
from coordshift.llm.lines import op5_lines
from coordshift.llm.mixing import op1_mixing
from coordshift.llm.neighbours import op2_neighbours
from coordshift.llm.passages import op10_passages
from coordshift.llm.simhash import op4_simhash
from coordshift.llm.suffix import op9_suffix


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_mixing, op2_neighbours, op3_contexttree, op4_simhash, op5_lines, op6_kneserney, op7_digest, op8_bpe, op9_suffix, op10_passages, pipeline)
    return {f.__name__: f for f in own}


#: The shortest sequences of 40 characters on from each line and back to it, by their text in place of hashes.
OP5_SQL = """
WITH d AS (SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS k, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT k, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS s FROM d),
w AS (SELECT k, text, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM t),
c AS (SELECT k, text, i, upto, upto - n AS before FROM (SELECT k, text, i, length(line) AS n, CAST(sum(length(line)) OVER (PARTITION BY k, text ORDER BY i) AS BIGINT) AS upto FROM w)),
f AS (SELECT a.k, a.text, a.i, b.i AS j FROM (SELECT *, (before + 40) * 100000000 AS goal FROM c) a ASOF JOIN (SELECT *, upto * 100000000 + i AS place FROM c) b ON a.k = b.k AND a.text = b.text AND a.goal <= b.place),
g AS (SELECT a.k, a.text, b.i, a.i AS j FROM (SELECT *, (upto - 40) * 100000000 + 99999999 AS goal FROM c) a ASOF JOIN (SELECT *, before * 100000000 + i AS place FROM c) b ON a.k = b.k AND a.text = b.text AND a.goal >= b.place),
p AS (SELECT u.k, u.text, u.i, u.j, array_to_string(t.s[u.i:u.j], chr(10)) AS name FROM (SELECT * FROM f UNION SELECT * FROM g) u JOIN t ON u.k = t.k AND u.text = t.text),
r AS (SELECT k, text, i, j, row_number() OVER (PARTITION BY name ORDER BY k, text, i) AS c FROM p),
x AS (SELECT DISTINCT k, text, unnest(range(i, j + 1)) AS j FROM r WHERE c > 1),
y AS (SELECT k, text, list(j) AS js, count(*) AS removed, sum(CASE WHEN q = j - 1 THEN 0 ELSE 1 END) AS runs FROM (SELECT k, text, j, lag(j) OVER (PARTITION BY k, text ORDER BY j) AS q FROM x) GROUP BY k, text),
l AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS k, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT l.doc_id, CAST(len(l.l) AS BIGINT) AS n_lines, CAST(coalesce(y.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(y.runs, 0) AS BIGINT) AS n_runs,
       sha256(CASE WHEN y.js IS NULL THEN l.text ELSE array_to_string(list_transform(list_filter(list_zip(l.l, range(1, len(l.l) + 1)), lambda x: NOT list_contains(y.js, x[2])), lambda x: x[1]), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN y ON l.k = y.k AND l.text = y.text
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_lines": OP5_SQL}
