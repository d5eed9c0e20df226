"""URL filters by a temporal list join, in DataFrame functions only.

A list is a table of dated entries: from its day on, `key` has the status 'block', 'allow' or 'none'
until the key's next entry. Entries become validity intervals, and each capture is joined as of its
fetch time to the intervals of its keys: its host with each prefix of its path, by whole segments, the
host alone, and each suffix of the host by whole labels, at least two. The most specific key with an
active status other than 'none' decides: the longest path, then the longest host. A capture without one
is kept.

Only different (URL, fetch time) pairs are taken apart into narrow rows (capture, level, key); what
matches is reduced to the most specific hit of a pair before it is joined to the captures. A key has at
most one interval at any time, so no join adds rows, and repeated captures of one URL meet as one row.

Defined results: a null or malformed URL has no keys and is kept; with a null fetch time no entry is
active; entries of one key on one day count as one, 'block' before 'allow' before 'none'; repeated
captures stay repeated; an empty list keeps all; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.llm.common import free, let, quoted, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = HOST + r"(?::[0-9]*)?(/[^/?#]+)"
PATH = HOST + r"(?::[0-9]*)?(/[^?#]*)"
DOMAIN = r"([^.]+\.[^.]+)$"


def keys_of(url: Column) -> dict[str, Column]:
    """The keys of a URL that `entries_of` lists, by level; null where it has none."""
    some = lambda x: F.when(x != "", x)
    host = F.lower(some(F.regexp_extract(url, HOST, 1)))
    segment = some(F.regexp_extract(url, SEGMENT, 2))
    return {"path": F.concat(host, segment), "host": host, "domain": some(F.regexp_extract(host, DOMAIN, 1))}


def levels_of(url: Column) -> Column:
    """All keys of a URL as an array of (level, key), the most specific first; empty where it has none.

    Paths have negative levels, by their number of segments; the host is 0, its suffixes count up.
    """
    host = F.lower(F.regexp_extract(url, HOST, 1))
    path = F.regexp_replace(F.regexp_extract(url, PATH, 2), "/+$", "")
    segments = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(path, 2, 1 << 30), "/"))
    named = lambda level, key: F.struct(level.cast("int").alias("level"), key.alias("key"))

    def of(x: Column) -> Column:
        host, segments, labels = x["host"], x["segments"], x["labels"]
        n = F.size(segments)
        deep = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        paths = F.transform(deep, lambda k: named(-k, F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))
        most = F.size(labels) - 2
        steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        suffixes = F.transform(steps, lambda k: named(k, F.array_join(F.slice(labels, k + 1, F.size(labels)), ".")))
        return F.concat(paths, F.array(named(F.lit(0), host)), F.filter(suffixes, lambda y: y["key"].rlike(DOMAIN)))

    parts = F.struct(host.alias("host"), segments.alias("segments"), F.split(host, r"\.").alias("labels"))
    return F.when(host != "", let(parts, of))


def intervals(entries: DataFrame) -> DataFrame:
    """key, status, since, until (null: open) from key, day, status.

    One row for each change of a key: entries that repeat the status before them are dropped, so that
    a key listed every day stays one interval.
    """
    worst = F.min_by("status", F.when(F.col("status") == "block", 0).when(F.col("status") == "allow", 1).otherwise(2))
    daily = entries.filter("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "day").agg(worst.alias("status"))
    by_day = Window.partitionBy("key").orderBy("day")
    changes = daily.withColumn("before", F.lag("status").over(by_day)).filter("before IS NULL OR before <> status")
    return changes.select("key", "status", F.col("day").alias("since"), F.lead("day").over(by_day).alias("until"))


FOUND = ("blocked", "matched_key", "listed_since")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All captures (url, fetched_at, ...) with blocked, matched_key and listed_since; own columns of these
    names are replaced."""
    valid = intervals(entries)
    pairs = captures.select("url", "fetched_at").filter("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    rows = pairs.select("url", "fetched_at", F.explode(levels_of(F.col("url"))).alias("x")).select("url", "fetched_at", "x.*")
    active = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    met = rows.join(valid.filter("status <> 'none'"), "key").filter(active)
    own = [c for c in captures.columns if c not in FOUND]
    url, at, hit = (free(n, captures.columns) for n in ("hit_url", "hit_at", "hit"))
    best = F.min_by(F.struct("status", "key", "since"), "level").alias(hit)
    hits = met.groupBy(F.col("url").alias(url), F.col("fetched_at").alias(at)).agg(best)
    out = captures.join(hits, (captures["url"] == hits[url]) & (captures["fetched_at"] == hits[at]), "left")
    return out.select(
        *quoted(own),
        F.coalesce(F.col(hit)["status"] == "block", F.lit(False)).alias("blocked"),
        F.col(hit)["key"].alias("matched_key"),
        F.col(hit)["since"].alias("listed_since"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures. The table has no fetch times: one page a minute, by page_id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("fetched_at"))


def entries_of(captures: DataFrame) -> DataFrame:
    """A dated list made of the captures' own keys, as the tables hold none.

    A key is listed at a quarter and changed at three quarters of the time in which it is seen. Hosts
    and domains are blocked, paths allowed, where the key's md5 (first 32 bits) is divisible by 3, 7, 5.
    """
    keys = keys_of(F.col("url"))
    rows = captures.select(
        "fetched_at",
        F.explode(
            F.array(
                F.struct(keys["path"].alias("key"), F.lit(5).alias("by"), F.lit("allow").alias("status")),
                F.struct(keys["host"].alias("key"), F.lit(3).alias("by"), F.lit("block").alias("status")),
                F.struct(keys["domain"].alias("key"), F.lit(7).alias("by"), F.lit("block").alias("status")),
            )
        ).alias("e"),
    ).select("fetched_at", "e.*")
    seen = (
        rows.filter("key IS NOT NULL AND CAST(conv(substr(md5(key), 1, 8), 16, 10) AS BIGINT) % by = 0")
        .groupBy("key", "status")
        .agg(F.unix_seconds(F.min("fetched_at")).alias("a"), F.unix_seconds(F.max("fetched_at")).alias("b"))
    )
    changes = F.array(
        F.struct((F.col("a") + F.floor((F.col("b") - F.col("a")) / 4)).alias("t"), F.col("status").alias("status")),
        F.struct((F.col("b") - F.floor((F.col("b") - F.col("a")) / 4)).alias("t"), F.lit("none").alias("status")),
    )
    return seen.select("key", F.explode(changes).alias("c")).select(
        "key", F.timestamp_seconds("c.t").alias("day"), F.col("c.status").alias("status")
    )


def op5_url_filters(spark, folder: str) -> DataFrame:
    """Every page as a capture, judged by the dated list made of the pages' keys."""
    captures = captures_of(table(spark, folder, "pages"))
    return judge(captures, entries_of(captures)).select(
        "page_id", "url", F.unix_seconds("fetched_at").alias("fetched"), "blocked", "matched_key",
        F.unix_seconds("listed_since").alias("listed"),
    )



OP5_SQL = r"""
WITH c AS (
  SELECT row_number() OVER () AS r, page_id, url, 1704067200 + page_id * 60 AS fetched,
         lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
         nullif(regexp_extract(url,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^/?#]+)', 2), '') AS segment
  FROM pages
), k AS (
  SELECT r, fetched, 1 AS level, host || segment AS key, 5 AS part, 'allow' AS status FROM c
  UNION ALL SELECT r, fetched, 2, host, 3, 'block' FROM c
  UNION ALL SELECT r, fetched, 3, nullif(regexp_extract(host, '([^.]+[.][^.]+)$', 1), ''), 7, 'block' FROM c
), seen AS (
  SELECT key, status, min(fetched) AS a, max(fetched) AS b FROM k
  WHERE key IS NOT NULL AND ('0x' || substr(md5(key), 1, 8))::BIGINT % part = 0 GROUP BY key, status
), iv AS (
  SELECT key, status, a + (b - a) // 4 AS since, b - (b - a) // 4 AS until FROM seen
), m AS (
  SELECT k.r, arg_min(iv.key, level) AS key, arg_min(iv.status, level) AS status, arg_min(iv.since, level) AS since
  FROM k JOIN iv ON k.key = iv.key AND fetched >= since AND (fetched < until OR since = until) GROUP BY k.r
)
SELECT page_id, url, fetched, coalesce(status = 'block', false) AS blocked, key AS matched_key, since AS listed
FROM c LEFT JOIN m USING (r)
"""
