"""Sharding by size-tiered compaction under a versioned manifest.

Only DataFrame functions and Spark's own writers move rows: no Python runs on the executors.

* Append. An arrival is written as one run: a folder of small immutable shards of about the same size, made by one scan
  without a shuffle or rewriting.
* Tiers. A run's tier is how many times ``fanout`` fits between the least shard size and its shards' mean size. A tier
  whose runs have at least ``fanout`` shards is merged into one run: Spark's reader packs whole files into partitions of
  the target size, each of which one task writes as one shard, so merging needs no shuffle either. Runs whose shards are
  over half the target on average are settled and never rewritten. Merging goes on until no tier is due; every merge
  lifts its rows by a tier at least, so it ends, and each row is rewritten about log(target / arrival) times. Where a
  session's own settings keep the reader from packing, its partitions are joined without a shuffle instead, and a merge
  that leaves as many shards as there were settles them.
* Manifest. A version lists its shards with run, rows, bytes and tier. It is written beside the table and then renamed
  to its number; the rename fails if that version exists, so of two writers one loses and nothing is half seen. This
  asks for a file system that renames folders in one step (HDFS, local and most mounted ones; not plain object stores).
  Readers list the newest version and read the folders of its runs; older versions stay readable until they expire.

The driver handles names of runs, one for each write that still has rows, never those of shards. Tasks that are lost
write their files again: a run's folder is complete when its write has been committed, and only then named.

Defined results: null columns are kept as they are; an empty table commits a manifest without shards and reads back as
an empty table; repeated rows stay repeated; columns may have any name, as file facts come from hidden metadata.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gritstone.llm.storage import scratch_path

MANIFEST = "run string, path string, rows bigint, bytes bigint, tier int"
TARGET_BYTES = 64 << 20
ARRIVAL_ROWS = 2000
LEAST_BYTES = 1 << 20
FANOUT = 4
#: The tier of shards that are not merged again.
SETTLED = 99


@contextmanager
def _settings(spark: SparkSession, **conf: str):
    """Session settings for the time of one write."""
    names = {f"spark.sql.files.{k}": v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ShardTable:
    """A table of immutable shards under ``root``, any folder that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), StructType([*schema.fields])
        for field in self.schema.fields:
            field.nullable = True
        self.target_bytes, self.least_bytes, self.fanout = target_bytes, least_bytes, fanout

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._path("manifest")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{have[-1] if version is None else version}")

    def commit(self, shards: DataFrame, after: int) -> int:
        """Publish ``shards`` as version ``after + 1``, in one rename; FileAlreadyExistsException if another writer did."""
        draft = f"manifest-drafts/{uuid.uuid4().hex}"
        shards.select("run", "path", "rows", "bytes", "tier").write.parquet(f"{self.root}/{draft}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = self._path("manifest")
        folder.getFileSystem(conf).mkdirs(folder)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(self._path(draft), self._path(f"manifest/v{after + 1}"), none)
        return after + 1

    def _tier(self, mean: float, least: int = 0) -> int:
        if 2 * mean > self.target_bytes:
            return SETTLED
        return max(least, int(math.log(max(mean / self.least_bytes, 1.0), self.fanout)))

    def _rows(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{r}" for r in runs])

    def _packed(self, runs: list[str], size: int) -> DataFrame:
        """The rows of ``runs``, ``size`` bytes in all, in partitions of about the target size.

        Packed files fill more than half of any two partitions, so more partitions than these come from other settings.
        """
        rows, want = self._rows(runs), max(1, -(-size // self.target_bytes))
        made = rows._jdf.queryExecution().toRdd().getNumPartitions()
        return rows.coalesce(want) if made > 2 * want + 1 else rows

    def _written(self, run: str, least: int = 0, before: int | None = None) -> DataFrame:
        """What a write left as ``run``, as manifest rows; ``before`` is how many shards it merged."""
        made = self._rows([run])
        facts = made.select(made.metadataColumn("_metadata").alias("m")).select(F.col("m.file_path").alias("path"), F.col("m.file_size").alias("bytes"))
        shards = facts.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))
        mean, n = shards.agg(F.avg("bytes"), F.count(F.lit(1))).first()
        tier = SETTLED if before is not None and n >= before else self._tier(mean or 0.0, least)
        return shards.select(F.lit(run).alias("run"), "path", "rows", "bytes", F.lit(tier).alias("tier"))

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Write an arrival as a run of small shards, and commit it beside the ones there are."""
        have = self.versions()
        run = uuid.uuid4().hex
        rows.write.option("maxRecordsPerFile", arrival_rows).parquet(f"{self.root}/data/{run}")
        return self.commit(self.manifest().unionByName(self._written(run)), have[-1] if have else 0)

    def runs(self, version: int | None = None) -> list:
        """The runs of a version: run, tier, shards, bytes; one row for each write that it still reads."""
        return self.manifest(version).groupBy("run", "tier").agg(F.count(F.lit(1)).alias("shards"), F.sum("bytes").alias("bytes")).orderBy("run").collect()

    def compact(self) -> int:
        """Merge due tiers until none is due; each round is one commit. The newest version."""
        while True:
            have, tiers = self.versions(), {}
            for r in self.runs():
                tiers.setdefault(r["tier"], []).append(r)
            due = sorted(t for t, runs in tiers.items() if t < SETTLED and sum(r["shards"] for r in runs) >= self.fanout)
            if not due:
                return have[-1]
            kept = self.manifest().filter(~F.col("tier").isin(due))
            for tier in due:
                run = uuid.uuid4().hex
                with _settings(self.spark, maxPartitionBytes=str(self.target_bytes), openCostInBytes="0", minPartitionNum="1"):
                    self._packed([r["run"] for r in tiers[tier]], sum(r["bytes"] for r in tiers[tier])).write.parquet(f"{self.root}/data/{run}")
                kept = kept.unionByName(self._written(run, tier + 1, sum(r["shards"] for r in tiers[tier])))
            self.commit(kept, have[-1])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        runs = [r["run"] for r in self.runs(version)]
        return self._rows(runs) if runs else self.spark.createDataFrame([], self.schema)

    def rows_by_shard(self, version: int | None = None) -> DataFrame:
        """The rows of a version with _shard: struct(shard, shard_rows, shard_bytes, tier); a shard is named by its file."""
        rows = self.read(version)
        if not self.manifest(version).take(1):
            return rows.withColumn("_shard", F.lit(None).cast("struct<shard:string,shard_rows:bigint,shard_bytes:bigint,tier:int>"))
        name = F.concat_ws("/", "run", F.regexp_extract("path", r"part-(\d+)[^/]*?-c(\d+)", 1), F.regexp_extract("path", r"part-(\d+)[^/]*?-c(\d+)", 2))
        facts = self.manifest(version).select(F.col("path").alias("_gritstone_of"), F.struct(name.alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier").alias("_shard"))
        return rows.withColumn("_gritstone_path", rows.metadataColumn("_metadata")["file_path"]).join(facts, F.col("_gritstone_path") == F.col("_gritstone_of")).drop("_gritstone_path", "_gritstone_of")

    def expire(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions, and the runs that only those name."""
        have = self.versions()
        old, new = have[:-keep], have[-keep:]
        named = lambda vs: {r["run"] for v in vs for r in self.runs(v)}
        drop = named(old) - named(new) if old else set()
        conf = self.spark._jsc.hadoopConfiguration()
        for name in [f"manifest/v{v}" for v in old] + [f"data/{run}" for run in drop]:
            path = self._path(name)
            path.getFileSystem(conf).delete(path, True)


def shard_documents(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS) -> ShardTable:
    """Append ``docs`` as an arrival to the table at ``root`` (a new one by default), compact it and drop what merging replaced."""
    spark = docs.sparkSession
    table = ShardTable(spark, root or scratch_path(spark, "shards"), docs.schema, target_bytes)
    table.append(docs, arrival_rows)
    table.compact()
    table.expire()
    return table


def digest(docs: DataFrame) -> DataFrame:
    """Where each document is: (doc_id, n_bytes, text_sha256, shard, shard_rows, shard_bytes, tier), read back from the shards."""
    rows = shard_documents(docs).rows_by_shard()
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "_shard.*")
