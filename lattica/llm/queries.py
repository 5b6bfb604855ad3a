"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, jaccard, langid, licenses, negatives, packing, quality, rules, sharding, suffixes, tokenstore, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.equal_texts(), shards=24)


def op2_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=5, num=3, den=4)


def op5_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)


def op9_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op11_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_suffix_array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digest(table(spark, sf_dir, "documents"))


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {f.__name__: f for f in (op1_balanced_propagation, op2_hyperdimensional_langid, op3_toxicity_chain, op4_jaccard_join, op5_license_automaton, op6_quality_ftrl, op7_ngram_ratio_rules, op8_retrieval_packing, op9_wand_decontamination, op10_token_files, op11_bit_sliced_negatives, op12_suffix_array_family, op13_exponion_codes)}

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def _codes_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other, every part against every entry."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, label, {_whole(4096)} AS c FROM embeddings WHERE {_FINITE})",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, c[p * {width} + 1:p * {width} + {width}] AS x FROM v, (SELECT unnest(range({parts})) AS p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM part WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        d2 = "list_sum(list_transform(list_zip(part.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
        ctes.append(f"near{r} AS MATERIALIZED (SELECT part.vec_id, part.p, any_value(part.label) AS label, any_value(part.x) AS x, min(CAST({d2} AS BIGINT) * {entries} + b.e) AS k FROM part JOIN book{r} b ON b.p = part.p GROUP BY part.vec_id, part.p)")
        if r < rounds:
            ctes.append(f"mean{r} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT p, k % {entries} AS e, i, sum(x[i]) AS s, count(*) AS n FROM near{r}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY ALL)) GROUP BY p, e)")
            ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)")
    ctes.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', k % {entries}), '' ORDER BY p) AS code, CAST(sum(k // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    book = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds})"
    return "WITH " + ", ".join(ctes) + f" SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {book} AS codebooks_sha256 FROM coded"


SQL: dict[str, str] = {
    "op11_bit_sliced_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, CAST({_whole(256)} AS DOUBLE[]) AS c FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
pair AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.c, r.c) AS BIGINT) AS score FROM v a, v r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positive AS (SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) QUALIFY row_number() OVER w <= 10
""",
    "op13_exponion_codes": _codes_sql(),
    "op4_jaccard_join": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM both_ JOIN size p ON p.doc_id = u JOIN size q ON q.doc_id = v WHERE 100 * c >= 75 * (p.n + q.n - c)),
side AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT DISTINCT u AS node, u AS low FROM side UNION SELECT side.v, reach.low FROM reach JOIN side ON side.u = reach.node),
part AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(part.low, doc.doc_id) AS component_id
FROM doc LEFT JOIN size ON size.doc_id = doc.doc_id LEFT JOIN part ON part.node = doc.doc_id
""",
}
