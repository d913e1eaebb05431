"""The thin queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense.llm import bpe_codec, centroid_clusters, licenses, mixing, near_dup, quality_cnn, quality_rules, token_counts, token_files, topk_kdtree, toxicity, vector_codes, warc_zip
from roomsense.llm.common import pick, read

TOKEN_LIMIT = 512
TOXIC_FROM = 0.7
GOOD_FROM = 0.3


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode(read(spark, sf_dir, "documents")).withColumn("n_tokens", F.size("ids").cast("long"))
    return bpe_codec.decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = pick(read(spark, sf_dir, "labels"), id="doc_id", y="quality").where(remainder("id", 5) != 0)
    scored = quality_cnn.score(docs, quality_cnn.fit(pick(docs, id="doc_id", text="text"), labels))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_kdtree.top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(read(spark, sf_dir, "documents")).drop("rejected_by")


def remainder(doc_id, of: int):
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % of


def toxicity_index(spark: SparkSession, sf_dir: str) -> toxicity.Index:
    labels = pick(read(spark, sf_dir, "labels"), id="doc_id", y="toxic").where(remainder("id", 3) != 1)
    return toxicity.fit(pick(read(spark, sf_dir, "documents"), id="doc_id", text="text"), labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), toxicity_index(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "evidence")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.write_packages(read(spark, sf_dir, "pages"))
    return warc_zip.read_packages(spark, packages, payloads=False).drop("url")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(read(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_files(read(spark, sf_dir, "documents"))
    return token_files.read_files(spark, files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


#: Kept vectors as lists of integers (exact in doubles).
_KEPT_SQL = """
SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_SQUARED = "list_inner_product({0}, {0}) - 2 * list_inner_product({0}, {1}) + list_inner_product({1}, {1})"
_FLOOR = "CAST((s - ((s % c) + c) % c) // c AS DOUBLE)"


def codes_sql(rounds: int = 4, parts: int = 4) -> str:
    """Lloyd's rounds of every part position as one query: a CTE for each assignment and each codebook."""
    steps = [f"""
WITH v AS MATERIALIZED ({_KEPT_SQL.format(scale=1024)}),
x AS MATERIALIZED (SELECT row, vec_id, label, p AS part, list_slice(q, p * len(q) // {parts} + 1, (p + 1) * len(q) // {parts}) AS x
    FROM (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS row FROM v), range({parts}) AS r(p)),
b0 AS MATERIALIZED (SELECT part, row AS entry, x AS e FROM x WHERE row < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(label) AS label, x.part, any_value(x) AS x,
    min(struct_pack(d := {_SQUARED.format("x", "e")}, n := entry)) AS best FROM x JOIN b{r} USING (part) GROUP BY row, x.part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (SELECT part, entry, list({_FLOOR} ORDER BY pos) AS e FROM (
        SELECT part, best.n AS entry, pos, CAST(sum(CAST(x[pos] AS HUGEINT)) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS c
        FROM a{r}, LATERAL (SELECT unnest(generate_series(1, len(x))) AS pos) GROUP BY part, entry, pos) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (part, entry))""")
    steps.append(f"""
f AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', best.n), '' ORDER BY part) AS code,
    CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)""")
    return ",".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(CAST(e[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos))
     FROM b{rounds}, LATERAL (SELECT unnest(generate_series(1, len(e))) AS pos)) AS codebooks_sha256 FROM f"""


def clusters_sql(rounds: int = 3, k: int = 16) -> str:
    steps = [f"""
WITH v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS row
    FROM ({_KEPT_SQL.format(scale=64)}) WHERE len(q) = 64),
c0 AS MATERIALIZED (SELECT row AS n, q AS e FROM v WHERE row < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(q) AS q,
    min(struct_pack(d := {_SQUARED.format("q", "e")}, n := n)) AS best FROM v, c{r} GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (SELECT n, list({_FLOOR} ORDER BY pos) AS e FROM (
        SELECT best.n AS n, pos, CAST(sum(CAST(q[pos] AS HUGEINT)) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS c
        FROM a{r}, LATERAL (SELECT unnest(generate_series(1, 64)) AS pos) GROUP BY best.n, pos) GROUP BY n),
c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (n))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(best.n AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
    CAST(sum(best.d) OVER (PARTITION BY best.n) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.n = n"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_near_dup": op1_near_dup, "op2_mixing": op2_mixing, "op3_bpe_codec": op3_bpe_codec, "op4_token_counts": op4_token_counts, "op5_quality_cnn": op5_quality_cnn, "op6_topk": op6_topk, "op7_license_scan": op7_license_scan, "op8_quality_rules": op8_quality_rules,
            "op9_toxicity": op9_toxicity, "op10_warc_zip": op10_warc_zip, "op11_vector_codes": op11_vector_codes,
            "op12_centroid_clusters": op12_centroid_clusters, "op13_token_files": op13_token_files}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": TOPK_SQL, "op8_quality_rules": quality_rules.ORACLE_SQL, "op11_vector_codes": codes_sql(),
            "op12_centroid_clusters": clusters_sql()}
