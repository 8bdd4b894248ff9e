"""One query per operator over its whole table, with production parameters, and its SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact, language, lexical, licenses, near, packing, pii, resample, substrings, tiling, token_index, toxicity, whiten
from quarry.llm.common import documents
from quarry.session import scratch


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_index.write(documents(spark, sf_dir), path)
    return token_index.read(spark, path)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that leaks into it."""
    return tiling.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per license notice."""
    return licenses.scan(documents(spark, sf_dir))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn."""
    return resample.draw(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(documents(spark, sf_dir))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_token_index, op2_substring_dedup, op3_packing, op4_decontamination, op5_personal_data, op6_near_copies, op7_licenses,
        op8_importance_resampling, op9_toxicity, op10_exact_dedup, op11_language, op12_whitening, op13_lexical_search,
    )
    return {f.__name__: f for f in own}


OP10_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


#: Windows of 100 bytes by their first place; removed ones joined to spans, what lies between them put together again.
OP2_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
  w AS (SELECT doc_id, s, t[s + 1 : s + 100] AS g FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 99)) AS s FROM b)),
  gone AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
  run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (
    SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM gone)),
  span AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM run GROUP BY doc_id, k),
  kept AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS u FROM span UNION ALL
    SELECT doc_id, coalesce((SELECT max(e) FROM span WHERE span.doc_id = b.doc_id), 0), octet_length(t) FROM b),
  joined AS (SELECT doc_id, string_agg(hex(t[f + 1 : u]), '' ORDER BY f, u) AS h FROM kept JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM b JOIN joined USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY 1) USING (doc_id)
"""

#: All pairs that share a shingle, counted, and the transitive closure of those that reach the threshold.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
  n AS (SELECT doc_id, len(s) AS n FROM s), g AS (SELECT doc_id, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
  both_ AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT both_.y, r.root FROM r JOIN both_ ON both_.x = r.doc_id)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""

#: Postings of all documents, joined with those of the items.
OP13_SQL = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    UNION ALL SELECT 'i', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
  p AS (SELECT side, id, term, count(*) AS tf FROM t GROUP BY ALL),
  d AS (SELECT id, sum(tf)::BIGINT AS n FROM p WHERE side = 'd' GROUP BY id),
  c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
  w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c WHERE side = 'd' GROUP BY term),
  s AS (SELECT i.id AS item_id, p.id AS doc_id, sum(i.tf * w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
    FROM p JOIN p AS i ON i.term = p.term AND i.side = 'i' AND p.side = 'd' JOIN w ON w.term = p.term JOIN d ON d.id = p.id, c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op6_near_copies": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op13_lexical_search": OP13_SQL}
