"""From raw documents to training shards: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents.

1. ``quality``: documents that the line field rejects go. It is trained on the labelled documents among its input that
   are not held out.
2. ``near_duplicates``: of each group of linked documents the one with the smallest id stays (null ids count as the
   largest; of rows that share it, the one with the least hash of its text). Texts without words link with nothing and
   stay; of rows that repeat an id and a text, one stays; an id's other texts do not go with one that is a copy.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``mix``: sources are mixed to their target weights; a document comes as often as the mix takes it, in training order.
5. ``shard``: the mixture is appended to a new shard table and compacted; the result is read back through the committed
   manifest, each row with its shard.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name, which stay as they are. ``quality`` scores a null or empty text like one empty line; without usable labels it keeps
all rows if the share of good labels is at least a half (or unknown), else none. ``decontaminate`` keeps null and empty
texts, as they hold nothing, and every row if the benchmark is empty. ``mix`` never takes documents without words, takes a
null source for one of its own, last in order, and treats repeated rows like any. ``shard`` keeps every row it is given; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm import decontaminate, mixing, parity_join, quality_crf, sharding
from gritstone.llm.storage import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.keep_good(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = parity_join.linked_rows(docs)
    gone = linked.filter("NOT stays").select(F.col("id").isNull().alias("_g0"), F.coalesce("id", F.lit(0)).alias("_g1"), F.col("text_key").alias("_g2")).distinct()
    names = [f"_c{i}" for i in range(len(docs.columns))]  # so that no column of docs can clash with the ones made here
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    marked = docs.toDF(*names).select("*", doc_id.isNull().alias("_k0"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("_k1"), F.xxhash64(text).alias("_k2"))
    # a row goes by its id and its text, so null and repeated ids take no other text along
    kept = marked.join(gone, [F.col(f"_k{i}") == F.col(f"_g{i}") for i in range(3)], "left_anti")
    kept = kept.withColumn("_copy", F.row_number().over(Window.partitionBy("_k0", "_k1", "_k2").orderBy("_k2")))
    return kept.filter("_copy = 1").select(*names).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(docs).rows_by_shard()
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_shard.{c}").alias(c if c not in docs.columns else f"_{c}") for c in ("shard", "shard_rows", "shard_bytes", "tier")])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mix), ("shard", shard)]
#: SQL cannot express the trained field, the latent search and the shards' files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
