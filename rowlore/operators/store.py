"""The record store on parquet: S8-S13.

A collection is a directory of generations, each partitioned by dataset and by a hash
bucket of the record id. A write puts the buckets that it changes into a new generation; a
manifest names the generation of every bucket, with a digest of its keys. What a write did is
there once its version is committed, and not before.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowlore.model import RECORD_SCHEMA, VECTOR_WIDTH
from rowlore.operators.records import project_record
from rowlore.plans.sizing import broadcast_if_small, materialize

KEY = ["dataset", "bucket", "id"]
BUCKET = ["dataset", "bucket"]
COLLECTION_SCHEMA = "collection string, vector_width int, buckets int"
MANIFEST_SCHEMA = "dataset string, bucket int, generation string, records long, key_sum long, key_xor long"


@dataclass(frozen=True)
class Written:
    """What an upsert did with its batch: rejected rows have no id or dataset, superseded ones lost to a later one."""

    received: int
    rejected: int
    inserted: int
    replaced: int
    superseded: int


def key_digest() -> list[Column]:
    """Count, sum and exclusive-or of the hashed ids of a bucket, in no order."""
    hashed = F.xxhash64("id")
    return [
        F.count("*").alias("records"), F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))).alias("key_sum"), F.bit_xor(hashed).alias("key_xor"),
    ]


class RecordStore:
    """Collections of records below one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._bucket_counts: dict[str, int] = {}

    def _path(self, collection: str) -> str:
        return f"{self.root}/records/{collection}"

    def _files(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._files(path)
        return fs.exists(target)

    # S13
    def create(self, collection: str, vector_width: int = VECTOR_WIDTH, buckets: int = 16) -> None:
        """Create a collection unless it exists; size buckets for about 1 GB of records each."""
        if not self.exists(collection):
            row = self.spark.createDataFrame([(collection, vector_width, buckets)], COLLECTION_SCHEMA)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/collections/name={collection}")

    def exists(self, collection: str) -> bool:
        return self._exists(f"{self.root}/collections/name={collection}")

    def list_collections(self) -> DataFrame:
        if not self._exists(f"{self.root}/collections"):
            return self.spark.createDataFrame([], COLLECTION_SCHEMA)
        return self.spark.read.schema(COLLECTION_SCHEMA).option("recursiveFileLookup", "true").parquet(
            f"{self.root}/collections"
        )

    def drop(self, collection: str) -> None:
        """Drop a collection and its records; a missing one is not an error."""
        self._bucket_counts.pop(collection, None)
        for path in (self._path(collection), f"{self.root}/collections/name={collection}"):
            fs, target = self._files(path)
            fs.delete(target, True)

    def buckets(self, collection: str) -> int:
        """Bucket count of a collection; fixed at creation, so read once."""
        if collection not in self._bucket_counts:
            row = self.list_collections().where(F.col("collection") == collection).first()
            if row is None:
                raise ValueError(f"collection {collection!r} does not exist")
            self._bucket_counts[collection] = row["buckets"]
        return self._bucket_counts[collection]

    def _bucketed(self, collection: str, df: DataFrame) -> DataFrame:
        # The bucket depends on nothing but the id, so readers can compute it.
        return df.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets(collection))).cast("int"))

    def _version(self, collection: str) -> tuple[int, list[Row]]:
        """The last committed version and its manifest: a row for each bucket."""
        fs, target = self._files(f"{self._path(collection)}/versions")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(target)] if fs.exists(target) else []
        if not numbers:
            return 0, []
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(target, str(max(numbers))))
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        manifest = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self._path(collection)}/manifests/{name}")
        return max(numbers), manifest.collect()

    def _commit(self, collection: str, version: int, manifest: list[Row]) -> None:
        """Make a version the current one; fails if another write has committed that version."""
        name = uuid.uuid4().hex
        rows = self.spark.createDataFrame(manifest, MANIFEST_SCHEMA)
        rows.coalesce(1).write.parquet(f"{self._path(collection)}/manifests/{name}")
        fs, target = self._files(f"{self._path(collection)}/versions/{version}")
        stream = fs.create(target, False)
        stream.write(bytearray(name.encode()))
        stream.close()

    def _rows(self, collection: str, manifest: list[Row]) -> DataFrame:
        """The records of these buckets, pruned to their folders."""
        schema = f"{RECORD_SCHEMA}, generation string, dataset string, bucket int"
        if not manifest:
            return self.spark.createDataFrame([], schema).drop("generation")
        listed: dict[tuple[str, str], list[int]] = {}
        for row in manifest:
            listed.setdefault((row["generation"], row["dataset"]), []).append(row["bucket"])
        named = [(F.col("generation") == g) & (F.col("dataset") == d) & F.col("bucket").isin(*b) for (g, d), b in listed.items()]
        stored = self.spark.read.schema(schema).parquet(f"{self._path(collection)}/data")
        return stored.where(reduce(or_, named)).drop("generation")

    def read(self, collection: str) -> DataFrame:
        """All records of the current version; the schema is stated, so dataset names are never read as numbers."""
        return self._rows(collection, self._version(collection)[1])

    def _replace(self, collection: str, version: int, kept: list[Row], records: DataFrame) -> list[Row]:
        """Write buckets as a new generation and commit them beside the `kept` ones."""
        generation = uuid.uuid4().hex
        path = f"{self._path(collection)}/data/generation={generation}"
        # Rebalancing gives each bucket few files and lets AQE split one that is too large; sorted ids and
        # their bloom filters let a point read skip row groups.
        sorted_ids = records.hint("rebalance", *BUCKET).sortWithinPartitions(*BUCKET, "id")
        sorted_ids.write.option("parquet.bloom.filter.enabled#id", "true").partitionBy(*BUCKET).parquet(path)
        written = self.spark.read.schema("id string, dataset string, bucket int").parquet(path)
        digests = written.groupBy(*BUCKET).agg(*key_digest())
        new = digests.select(*BUCKET, F.lit(generation).alias("generation"), "records", "key_sum", "key_xor").collect()
        self._commit(collection, version + 1, [*kept, *new])
        return new

    # S8, S9
    def upsert(self, collection: str, batch: DataFrame, order: str = "ingest_seq") -> Written:
        """Write records; for equal (dataset, id) the highest `order` wins, of equal ones the last write.

        All or nothing: the batch is there once its version is committed. Only buckets that
        receive records are read, and written anew; the batch is evaluated once. Rows without
        id or dataset are rejected and counted. Of two writes at once one fails.
        """
        incoming = materialize(self._bucketed(collection, as_records(batch)), "incoming")
        named = F.col("id").isNotNull() & F.col("dataset").isNotNull()
        received = incoming.agg(F.count("*").alias("n"), F.count_if(named).alias("named")).first()
        incoming = incoming.where(named)
        version, manifest = self._version(collection)
        touched = {tuple(r) for r in incoming.select(*BUCKET).distinct().collect()}
        if not touched:
            return Written(received["n"], received["n"], 0, 0, 0)
        old = [r for r in manifest if (r["dataset"], r["bucket"]) in touched]
        stored = self._rows(collection, old).withColumn("_new", F.lit(0))
        merged = latest(stored.unionByName(incoming.withColumn("_new", F.lit(1))), order, "_new")
        seen = Observation()
        new = self._replace(collection, version, [r for r in manifest if r not in old], merged.observe(seen, F.sum("_new").alias("kept")).drop("_new"))
        kept, inserted = seen.get["kept"], sum(r["records"] for r in new) - sum(r["records"] for r in old)
        return Written(received["n"], received["n"] - received["named"], inserted, kept - inserted, received["named"] - kept)

    # S10
    def delete(self, collection: str, keys: DataFrame) -> int:
        """Delete by (dataset, id), all or nothing, and tell how many there were; missing keys are not an error."""
        version, manifest = self._version(collection)
        if not manifest:
            return 0
        keys = self._bucketed(collection, keys.select("dataset", "id").distinct())
        held = F.broadcast(self.spark.createDataFrame(manifest, MANIFEST_SCHEMA).select(*BUCKET))  # a row for each bucket
        touched = {tuple(r) for r in keys.select(*BUCKET).distinct().join(held, BUCKET, "left_semi").collect()}
        old = [r for r in manifest if (r["dataset"], r["bucket"]) in touched]
        if not old:
            return 0
        left = self._rows(collection, old).join(keys, KEY, "left_anti")
        new = self._replace(collection, version, [r for r in manifest if r not in old], left)
        return sum(r["records"] for r in old) - sum(r["records"] for r in new)

    # S12
    def confirm(self, collection: str, written: DataFrame) -> DataFrame:
        """Written keys (dataset, id) that the collection does not hold; empty when all are there.

        Keys are first compared by the digest of their bucket, which the manifest has;
        only buckets whose digests differ are read. Rows without id or dataset hold no key.
        """
        keys = self._bucketed(collection, written.select("dataset", "id").where("dataset IS NOT NULL AND id IS NOT NULL").distinct())
        keys = materialize(keys, "written")
        manifest = self._version(collection)[1]
        held = self.spark.createDataFrame(manifest, MANIFEST_SCHEMA).select(*BUCKET, F.struct("records", "key_sum", "key_xor").alias("_held"))
        own = keys.groupBy(*BUCKET).agg(*key_digest()).select(*BUCKET, F.struct("records", "key_sum", "key_xor").alias("_own"))
        differs = own.join(F.broadcast(held), BUCKET, "left").where(~F.col("_own").eqNullSafe(F.col("_held"))).select(*BUCKET)
        pairs = {tuple(r) for r in differs.collect()}
        stored = self._rows(collection, [r for r in manifest if (r["dataset"], r["bucket"]) in pairs])
        open_keys = keys.join(broadcast_if_small(materialize(differs, "differs")), BUCKET, "left_semi")
        return open_keys.join(stored.select(*KEY), KEY, "left_anti").select("dataset", "id")

    def vacuum(self, collection: str) -> int:
        """Remove generations that the current version does not name; not while others write."""
        current = {r["generation"] for r in self._version(collection)[1]}
        fs, target = self._files(f"{self._path(collection)}/data")
        old = [f.getPath() for f in fs.listStatus(target) if f.getPath().getName().removeprefix("generation=") not in current] if fs.exists(target) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

    # S11
    def get(self, collection: str, dataset: str, record_id: str, with_embedding: bool = False) -> DataFrame:
        """Point read: prunes to one dataset and bucket, empty when missing."""
        stored = self.read(collection)
        bucket = F.pmod(F.xxhash64(F.lit(record_id)), F.lit(self.buckets(collection))).cast("int")
        hit = stored.where(
            (F.col("dataset") == dataset) & (F.col("bucket") == bucket) & (F.col("id") == record_id)
        )
        return project_record(hit, with_embedding)


def as_records(df: DataFrame) -> DataFrame:
    """The record columns and the dataset; columns the input lacks are null."""
    wanted = StructType.fromDDL(f"{RECORD_SCHEMA}, dataset string")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
    )


def latest(df: DataFrame, order: str = "ingest_seq", *then: str) -> DataFrame:
    """One row per (dataset, id), the highest `order`, of equal ones the highest `then`, batch, file, row and text.

    Repeats are cut before the shuffle.
    """
    stable = ("import_batch_id", "file", "worksheet", "row_number", "text")
    w = Window.partitionBy("dataset", "bucket", "id").orderBy(*(F.desc(c) for c in (order, *then, *stable)))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def confirm_written(written: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("dataset", "id")) -> DataFrame:
    """Written keys that cannot be read back; empty when all are there."""
    return written.select(*keys).join(stored.select(*keys), list(keys), "left_anti")
