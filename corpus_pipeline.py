"""A training-data pipeline: each stage works on what the one before it kept, written as Parquet and read again.

``STAGES`` lists (name, function(spark, docs, sf_dir) -> DataFrame); ``run`` applies them to ``documents``.  All but the
last return the columns of documents, further ones included, in their order.

Each stage judges rows, not ids: null and repeated ids are documents of their own.  Null texts count as empty; empty texts
fall to the quality rules.  Texts of any length are judged whole.  Of near duplicates the smallest id stays (null ids stay
all); ties of the mix go by the hash of the id, then by row.  Repeated rows are near duplicates where they have ids.
Columns whose names clash with doc_id, text, source or a stage's own but for case are carried along untouched, by position;
the first column of exactly that name is the one meant.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense.llm import bpe_codec, mixing, near_dup, quality_rules, toxicity
from roomsense.llm.common import read, written
from roomsense.llm.queries import TOXIC_FROM, toxicity_index

PERCENT = 80   # near duplicates: 100 * intersection >= PERCENT * union of 5-word shingles
ROW = "__row"  # a key of the rows of a stage's input, written once with them, as ids can be null or repeated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit; every row is judged by its own text, whatever its id."""
    return toxicity.keep(docs, toxicity_index(spark, sf_dir), TOXIC_FROM)


def _by_place(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns c0, c1, ..., which clash with nothing, and what the named columns are called there."""
    lower = [n.lower() for n in docs.columns]
    places = [docs.columns.index(n) if n in docs.columns else lower.index(n) for n in names]
    return docs.toDF(*(f"c{i}" for i in range(len(lower)))), [f"c{i}" for i in places]


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id.  Null ids are kept, each row for itself."""
    rows, (doc_id, text) = _by_place(docs, "doc_id", "text")
    known, key = F.col(doc_id).isNotNull(), doc_id
    if not rows.where(known).groupBy(doc_id).count().where("count > 1").isEmpty():
        # rows that share an id are documents of their own: all are numbered, in the order of their ids
        rows = rows.orderBy(doc_id, F.xxhash64(text)).withColumn(ROW, F.when(known, F.monotonically_increasing_id()))
        rows, key = written(rows, "numbered"), ROW
    found = near_dup.near_duplicates(rows, id_col=key, text_col=text, percent=PERCENT)
    gone = found.where(~F.col("kept")).select(F.col(key).alias("gone"))
    return rows.join(gone, F.col(key) == F.col("gone"), "left_anti").drop(ROW).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows, (doc_id, text, source) = _by_place(docs, "doc_id", "text", "source")
    columns = rows.columns
    rows = written(rows.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    copies = mixing.mix(rows, id_col=doc_id, text_col=text, source_col=source, row_col=ROW).where("copies > 0")
    taken = rows.join(copies.select(F.col(ROW).alias("mixed_row"), "copies"), F.col(ROW) == F.col("mixed_row"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, their digest and the text that they decode to, for every document of the mix."""
    coded = bpe_codec.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))
    return bpe_codec.decode(coded, keep_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded")


STAGES = [("quality rules", quality), ("toxicity", clean), ("near-duplicates", distinct), ("mixing", mixed), ("bpe encoding and decoding", encoded)]

#: Nearest examples, tilted rates and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
