"""The ledger as a store: buckets of files under an append-only list of manifests.

    root/manifest/v=<number>.json    the files of every bucket, their rows, and the last batch of each stream
    root/data/<write>/bucket=<b>/    rows of one bucket as one write left them
    root/bloom/<write>/bucket=<b>/   its Bloom filter of finished URLs, one row for each block
    root/staged/<write>/             the updates of a write, one row for each key

A URL's bucket is a hash. An upsert reads and writes only the buckets that its updates fall in; the
others' files are named by the new manifest as they are. The manifest comes last and appears whole, so
a writer that dies before leaves the newest version as it was. A version can be made once: of two writers
who start from one version the second fails with ``VersionTaken`` and starts again from the newest.
Manifests are found by listing their own folder; data folders are never listed as a whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpage.operators.bloom import BITS, blocks_for, bloom_rows, bucket_of, possible
from siftpage.operators.ledger import FINISHED, LEDGER, latest, ledger_upsert
from siftpage.sources.shared_files import drop, names, publish_json, read_json

BLOOM = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType())]
    + [T.StructField(w, T.LongType()) for w in BITS]
)


class LedgerStore:
    """Reads and updates one ledger; ``buckets`` counts only when the first version is written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.first_buckets = spark, root.rstrip("/"), buckets

    # ---- versions ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        found = names(self.spark, f"{self.root}/manifest")
        return sorted(int(n[2:-5]) for n in found if n.startswith("v=") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, by default the newest; that of an empty ledger when there is none yet."""
        if version is None:
            version = max(self.versions(), default=0)
        if version:
            return read_json(self.spark, f"{self.root}/manifest/v={version}.json")
        return {"version": 0, "buckets": self.first_buckets, "schema": LEDGER.json(), "files": {}, "batches": {}}

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        wanted = manifest["files"] if buckets is None else {str(b): manifest["files"][str(b)] for b in buckets if str(b) in manifest["files"]}
        folders = [f"{self.root}/data/{write}/bucket={b}" for b, (write, _) in wanted.items()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    # ---- updates ----------------------------------------------------------------------------

    def upsert(self, updates: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Lay updates over the newest version (see ``ledger_upsert``); the number of the version they are in.

        batch: name of a stream and number of its batch. A batch that is in the ledger changes nothing.
        """
        old = self.manifest()
        if batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return old["version"]
        write, buckets = uuid.uuid4().hex, old["buckets"]
        if "last_updated" in updates.columns:
            updates = latest(updates, "url", "last_updated").select(*updates.columns)
        staged = f"{self.root}/staged/{write}"
        updates.filter("url is not null").withColumn("_bucket", bucket_of(F.col("url"), buckets)).write.parquet(staged)
        new = self.spark.read.parquet(staged)
        # as many numbers as there are buckets at most
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        merged = ledger_upsert(self._rows(old, touched), new.drop("_bucket"))
        files = dict(old["files"]) | self._written(merged, write, buckets)
        batches = dict(old["batches"]) | ({batch[0]: batch[1]} if batch else {})
        version = old["version"] + 1
        self._publish({
            "version": version, "base": old["version"], "buckets": buckets, "schema": merged.schema.json(),
            "files": files, "batches": batches,
        })
        return version

    def _written(self, rows: DataFrame, write: str, buckets: int) -> dict[str, list]:
        """Write rows by bucket with their filters; (write, rows) of each bucket."""
        data, blooms = f"{self.root}/data/{write}", f"{self.root}/bloom/{write}"
        placed = rows.withColumn("bucket", bucket_of(F.col("url"), buckets))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(data)
        back = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(data)
        counts = back.groupBy("bucket").agg(F.count("*").alias("n")).collect()
        done = back.filter(F.col("scrape_status").isin(*FINISHED)).select("bucket", "url")
        filters = bloom_rows(done, "url", self._sizes({str(b): (write, n) for b, n in counts}))
        filters.withColumn("of", F.col("bucket")).repartition("of").write.partitionBy("of").parquet(blooms)
        return {str(b): [write, n] for b, n in counts}

    def _publish(self, manifest: dict) -> None:
        publish_json(self.spark, f"{self.root}/manifest/v={manifest['version']}.json", manifest)

    def _sizes(self, files: dict) -> DataFrame:
        """bucket and blocks: one row for each bucket."""
        rows = [(int(b), n) for b, (_, n) in files.items()]
        return self.spark.createDataFrame(rows, "bucket int, n bigint").select("bucket", blocks_for(F.col("n")).alias("blocks"))

    # ---- pick-up ----------------------------------------------------------------------------

    def blooms(self, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        # a write that finished no URL in a bucket left no filter there
        by_write: dict[str, list[int]] = {}
        for b, (write, _) in manifest["files"].items():
            by_write.setdefault(write, []).append(int(b))
        out = self.spark.createDataFrame([], BLOOM)
        for write, own in by_write.items():
            rows = self.spark.read.schema(BLOOM).parquet(f"{self.root}/bloom/{write}").select(*BLOOM.names)
            out = out.unionByName(rows.filter(F.col("bucket").isin(own)))
        return out

    def tested(self, urls: DataFrame) -> DataFrame:
        """urls with ``_possible``: whether the filters leave it possible that the URL is finished."""
        manifest = self.manifest()
        return possible(urls, "url", self.blooms(manifest), self._sizes(manifest["files"]), manifest["buckets"])

    def pick_new(self, urls: DataFrame) -> DataFrame:
        """URLs that are not finished. Only those that the filters leave possible meet the ledger itself."""
        tested = self.tested(urls)
        done = self.read().filter(F.col("scrape_status").isin(*FINISHED)).select("url").distinct()
        unsure = tested.filter("_possible").join(done, "url", "left_anti")
        return tested.filter("not _possible").unionByName(unsure).select(*urls.columns)

    # ---- upkeep -----------------------------------------------------------------------------

    def vacuum(self, keep: int = 10) -> int:
        """Drop the files that none of the newest ``keep`` versions names; how many writes went.

        Not to be run beside a writer, whose files no manifest names yet.
        """
        used = {w for v in self.versions()[-keep:] for w, _ in self.manifest(v)["files"].values()}
        gone = [w for w in names(self.spark, f"{self.root}/data") if w not in used]
        for write in gone:
            for kind in ("data", "bloom", "staged"):
                drop(self.spark, f"{self.root}/{kind}/{write}")
        return len(gone)
