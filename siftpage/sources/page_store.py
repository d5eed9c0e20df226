"""Stored pages with a manifest, so that a run reads what is new and lists nothing else.

    root/index/<write>-<n>/             one narrow row for each page of a label: url, key, place, kind, bytes
    root/segments/<write>/              pages that a sink of this library wrote, many to a file
    root/manifest/v=<number>.json       the additions to the index, in order, each with its label

Whoever adds pages adds their rows to the index and then a manifest. Pages are found by an anti join of
the index with the ledger; only the segments, or the single files of a crawler, that hold one of those are
opened. A tree ``<label>/<key>/raw.html`` that something else wrote is listed once by ``adopt``, label by
label; the same call repairs the index of a label.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpage.functions.url import url_key
from siftpage.sources.shared_files import names, publish_json, read_json

INDEX = "url string, key string, label string, kind string, place string, bytes bigint"
PAGE = "url string, key string, label string, html string"
#: Paths of single files in one read.
PATHS = 5_000


class PageStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- manifest ---------------------------------------------------------------------------

    def _manifest(self) -> dict:
        found = names(self.spark, f"{self.root}/manifest")
        version = max((int(n[2:-5]) for n in found if n.startswith("v=") and n.endswith(".json")), default=0)
        if version:
            return read_json(self.spark, f"{self.root}/manifest/v={version}.json")
        return {"version": 0, "adds": []}

    def _publish(self, old: dict, adds: list[list[str]]) -> int:
        version = old["version"] + 1
        publish_json(self.spark, f"{self.root}/manifest/v={version}.json", {"version": version, "adds": adds})
        return version

    def index(self) -> DataFrame:
        """All pages that the manifest knows, without their content."""
        folders = [f"{self.root}/index/{folder}" for _, folder in self._manifest()["adds"]]
        reader = self.spark.read.schema(INDEX)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], INDEX)

    # ---- sinks ------------------------------------------------------------------------------

    def add(self, pages: DataFrame) -> int:
        """Append pages (url, label, html); the number of the version that knows them."""
        old, write = self._manifest(), uuid.uuid4().hex
        segments = f"{self.root}/segments/{write}"
        keyed = pages.select("url", url_key(F.col("url")).alias("key"), F.coalesce("label", F.lit("none")).alias("label"), "html")
        keyed.write.parquet(segments)
        stored = self.spark.read.schema(PAGE).parquet(segments)
        rows = stored.select(
            "url", "key", "label", F.lit("segment").alias("kind"), F.lit(write).alias("place"), F.octet_length("html").cast("bigint").alias("bytes")
        )
        return self._publish(old, [*old["adds"], *self._index(rows, write)])

    def adopt(self, tree: str, label: str, known: DataFrame) -> int:
        """Index one label's folder of a tree ``<label>/<key>/raw.html``, in place of what the index had of
        single files for it. known: url and key; a key of several URLs is indexed once for each.

        This is the one call that lists files, and it holds one label's listing at a time.
        """
        old, write = self._manifest(), uuid.uuid4().hex
        files = self.spark.read.format("binaryFile").load(f"{tree}/{label}/*/raw.html").select("path", "length")
        placed = files.withColumn("key", F.element_at(F.split("path", "/"), -2))
        urls = known.select("url", "key").distinct()
        rows = placed.join(urls, "key", "left").select(
            "url", "key", F.lit(label).alias("label"), F.lit("file").alias("kind"), F.col("path").alias("place"), F.col("length").alias("bytes")
        )
        found = self._index(rows, f"files-{write}")
        kept = [a for a in old["adds"] if not (a[0] == label and a[1].startswith("files-"))]
        return self._publish(old, [*kept, *found])

    def _index(self, rows: DataFrame, write: str) -> list[list[str]]:
        """Write index rows, a folder for each label (classes: a few); label and folder of each."""
        staged = f"{self.root}/staged/{write}"
        rows.write.parquet(staged)
        back = self.spark.read.schema(INDEX).parquet(staged)
        labels = sorted(r[0] for r in back.select("label").distinct().collect())
        for n, label in enumerate(labels):
            back.filter(F.col("label") == label).write.parquet(f"{self.root}/index/{write}-{n}")
        return [[label, f"{write}-{n}"] for n, label in enumerate(labels)]

    # ---- sources ----------------------------------------------------------------------------

    def pending(self, done: DataFrame) -> DataFrame:
        """Index rows whose URL is not in done (url); rows without a URL can't be told and are left out."""
        return self.index().filter("url is not null").join(done.select("url").distinct(), "url", "left_anti")

    def read(self, wanted: DataFrame) -> DataFrame:
        """url, key, label, html of index rows. Only segments and files that hold one of them are opened.

        The driver holds the names of the segments (one for each addition) and of the wanted single files.
        """
        places = wanted.select("kind", "place").distinct().collect()
        out = self.spark.createDataFrame([], PAGE)
        if segments := [f"{self.root}/segments/{p}" for k, p in places if k == "segment"]:
            out = out.unionByName(self.spark.read.schema(PAGE).parquet(*segments))
        keep = wanted.filter("kind = 'segment'").select("url", "label").distinct()
        out = out.join(keep, ["url", "label"], "left_semi").select("url", "key", "label", "html")
        files = sorted(p for k, p in places if k == "file")
        named = wanted.filter("kind = 'file'").select("url", "key", "label", "place")
        for at in range(0, len(files), PATHS):
            content = self.spark.read.format("binaryFile").load(files[at : at + PATHS])
            html = content.select(F.col("path").alias("place"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
            out = out.unionByName(named.join(html, "place").select("url", "key", "label", "html"))
        return out
