"""Sharding by balanced label propagation, under the law `bytes`: sizes near equal.

Documents and their links are a table of rows and one of memberships (row, hub): rows of one hub are
neighbours. Every row starts in a shard drawn by hash. In each round the members of every hub are
counted by shard; a linked row wants to go to the shard in which most of its neighbours are (ties: the
same choice for all, so that two rows never swap for ever) and gains the links that this uncuts. The
shards' free bytes are the quotas: per shard the wishes are summed by gain, the larger gains are
granted, and of the gain at which a quota ends the share that fits, whole hubs by hash. Rounds end when
no row moves, or after `ROUNDS`.

Then sizes are made even. Linked rows stay in their shard up to its capacity, hub by hub; what is
above, and all rows without links, which cut nothing wherever they go, stand in a line that is cut at
the shards' free bytes. A row lies where its middle lies. Large rows are placed first and small ones
then fill what is free, so a shard misses its capacity by less than a small row, if there are enough of
them. A group of equal texts that lies across a cut is divided there.

What meets in a task is never a group or a shard: counts of hubs and shards are merged before they
are shuffled, running sums go over slices of hash ranges whose number follows the rows, and a line is
made of one row for each text and shard. The driver sees sums by shard and gain only.

Defined results: null text is the empty text; every input row gets a shard and a slot, repeated rows
and null ids too; which of equal rows gets which slot depends on their order in the files; an empty
table gives no rows; fewer rows than shards leave shards empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.llm.common import table, written

SHARDS, ROUNDS = 8, 8
#: Rows of one slice of a running sum.
SLICE_ROWS = 20_000
LAW = "bytes"


def share_of(hash_: Column) -> Column:
    """Where a hash lies in its whole range, from 0 to below 1."""
    return F.least(hash_ / F.lit(2.0**64) + 0.5, F.lit(1 - 2.0**-53))


def running(df: DataFrame, keys: Sequence[str], order: str, value: Column, rows: Column) -> DataFrame:
    """df with `start`: the sum of `value` over the rows before, by `order` (a hash) below the same keys.

    rows: how many rows the keys have. They are dealt into slices by the hash; the sums of the
    slices are added up first. Rows of one hash may come in any order.
    """
    dealt = df.withColumns({
        "_value": value,
        "_slice": F.floor(share_of(F.col(order)) * F.ceil(rows / SLICE_ROWS)).cast("int"),
    })
    sums = dealt.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(ahead, [*keys, "_slice"])
        .withColumn("start", F.col("_ahead") + F.col("_within"))
        .select(*df.columns, "start")
    )


def wishes(placed: DataFrame, links: DataFrame, shards: int, turn: int) -> DataFrame:
    """row, size, shard, goal, gain and hub (the smallest) of the linked rows that want to move.

    placed: row, size, shard; links: row, hub. Ties go to the shard that comes first from `turn` on.
    """
    at = links.join(placed, "row")
    each = F.array(*(F.sum((F.col("shard") == k).cast("bigint")) for k in range(shards)))
    hubs = at.groupBy("hub").agg(each.alias("votes"))
    seen = at.join(hubs, "hub")
    own = seen.groupBy("row").agg(
        F.first("size").alias("size"),
        F.first("shard").alias("shard"),
        F.min("hub").alias("hub"),
        *(F.sum(F.get("votes", F.lit(k))).alias(f"v{k}") for k in range(shards)),
    )
    votes = F.array(*(F.struct(F.col(f"v{k}").alias("n"), F.lit(-((k - turn) % shards)).alias("t"), F.lit(k).alias("k")) for k in range(shards)))
    here = F.get(F.array(*(F.col(f"v{k}") for k in range(shards))), F.col("shard"))
    best = own.withColumn("best", F.array_max(votes)).withColumn("here", here)
    return best.filter(F.col("best.k") != F.col("shard")).select(
        "row", "size", "shard", "hub", F.col("best.k").alias("goal"), (F.col("best.n") - F.col("here") + 1).alias("gain")
    )


def grants(asked: Sequence[tuple[int, int, int]], free: Sequence[int]) -> list[tuple[int, int, float]]:
    """(goal, least gain class, share of that class) for each goal, from (goal, class, bytes)."""
    out = []
    for goal, room in enumerate(free):
        least, share = 1 << 30, 0.0
        for gain, size in sorted(((g, s) for k, g, s in asked if k == goal), reverse=True):
            least, share = gain, min(1.0, max(0, room) / size)
            room -= size
            if share < 1:
                break
        out.append((goal, least, share))
    return out


def propagate(
    placed: DataFrame, links: DataFrame, capacity: Sequence[int], rounds: int = ROUNDS
) -> tuple[DataFrame, list[int]]:
    """(placed with new shards, rows moved in each round). placed: row, size, shard of the linked rows; both
    written tables. Each round's rows are written, so a lost executor costs part of one round."""
    shards, moved = len(capacity), []
    for turn in range(rounds):
        wanted = written(wishes(placed, links, shards, turn % shards).withColumn("class", F.floor(F.log2("gain")).cast("int")), "wishes")
        asked = [tuple(r) for r in wanted.groupBy("goal", "class").agg(F.sum("size")).collect()]
        held = dict(placed.groupBy("shard").agg(F.sum("size")).collect())
        left = dict(wanted.groupBy("shard").agg(F.sum("size")).collect())
        # what wants to leave a shard makes room there, as far as it is sure to be let in elsewhere
        free = [capacity[k] - held.get(k, 0) for k in range(shards)]
        if sum(s for _, _, s in asked) <= min(free, default=0):
            free = [f + left.get(k, 0) for k, f in enumerate(free)]
        granted = F.lit(False)
        for goal, least, share in grants(asked, free):
            fits = (F.col("class") > least) | ((F.col("class") == least) & (share_of(F.xxhash64("hub")) < share))
            granted = granted | ((F.col("goal") == goal) & fits)
        moves = wanted.filter(granted).select("row", "goal")
        placed = written(
            placed.join(moves, "row", "left").select(
                "row", "size", F.coalesce("goal", "shard").alias("shard"), F.col("goal").isNotNull().alias("moved")
            ),
            "placed",
        )
        moved.append(placed.filter("moved").count())
        placed = placed.drop("moved")
        if not moved[-1]:
            break
    return placed, moved


def cut_links(placed: DataFrame, links: DataFrame) -> int:
    """Links, of each row with the largest part of its hub, that lie across shards."""
    each = links.join(placed, "row").groupBy("hub", "shard").count()
    return each.groupBy("hub").agg((F.sum("count") - F.max("count")).alias("cut")).agg(F.sum("cut")).first()[0] or 0


def within(borders: Sequence[int], place: Column) -> Column:
    """The index of the interval in which a place lies; borders: where each but the first begins."""
    return sum(((place >= F.lit(b)).cast("int") for b in borders), F.lit(0))


def in_line(rows: DataFrame, loose: DataFrame, count: int, borders: Sequence[int]) -> DataFrame:
    """row, size and shard of the rows of loose pieces (piece, shard, bytes, n), which stand in one line that
    is cut at the borders.

    Rows of one piece that lie between two borders are one row of the line; the few pieces that lie
    across a border are placed row by row.
    """
    # a piece has one row in the line for each shard that it was in
    line = running(
        loose.withColumns({"one": F.lit(0), "place": F.xxhash64("piece", "shard")}), ["one"], "place", F.col("bytes"), F.lit(count)
    )
    first = within(borders, F.col("start"))
    whole = first == within(borders, F.col("start") + F.col("bytes") - 1)
    goal = F.when(F.col("n") == 1, within(borders, F.col("start") + F.col("bytes") / 2)).when(whole, first)
    named = line.select(F.col("piece").alias("_piece"), F.col("shard").alias("_shard"), F.col("start").alias("from"), "n", goal.alias("goal"))
    joined = rows.join(named, (rows["piece"] == named["_piece"]) & rows["shard"].eqNullSafe(named["_shard"]))
    simple = joined.filter("goal is not null").select("row", "size", F.col("goal").alias("shard"))
    split = joined.filter("goal is null").select(
        "row", "size", "o", "piece", F.coalesce("_shard", F.lit(-1)).alias("was"), "from", "n"
    )
    split = running(split, ["piece", "was"], "o", F.col("size"), F.col("n"))
    place = F.col("from") + F.col("start") + F.col("size") / 2
    return simple.unionByName(split.select("row", "size", within(borders, place).alias("shard")))


def shares(room: Sequence[int], total: int) -> list[int]:
    """Borders of a line of `total` bytes that is divided in proportion to the room of each shard."""
    room = [max(0, r) for r in room]
    return [total * sum(room[: k + 1]) // max(1, sum(room)) for k in range(len(room) - 1)]


def fine_class(sizes: dict[int, int], shards: int) -> int:
    """The class (power of two) of row sizes from which on rows go before: those below it hold enough
    bytes to make up for what the others miss the borders by. sizes: bytes by class."""
    enough, so_far = shards * 2 ** (max(sizes, default=0) + 1), 0
    for c in sorted(sizes):
        if so_far >= enough:
            return c
        so_far += sizes[c]
    return 0


def evened(rows: DataFrame, capacity: Sequence[int]) -> DataFrame:
    """row and shard for all rows: row, size, piece (hash of what should stay together), o (a hash of
    the row) and shard (null: anywhere). Sizes near the capacities, which add up to all bytes.

    Large loose rows go first, in proportion to the free bytes; small ones fill what is then free.
    """
    shards = len(capacity)
    pieces = written(rows.groupBy("piece", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "pieces")
    by_shard = pieces.groupBy("shard").agg(F.count("*").alias("pieces"))
    room = F.get(F.array(*(F.lit(int(c)) for c in capacity)), F.col("shard"))
    settled = pieces.filter("shard is not null").join(by_shard, "shard")
    settled = running(settled, ["shard"], "piece", F.col("bytes"), F.col("pieces"))
    settled = settled.withColumn("stays", F.col("start") + F.col("bytes") <= room)
    settled = written(settled.select("piece", "shard", "bytes", "n", "stays"), "settled")
    loose = settled.filter("not stays").drop("stays").union(pieces.filter("shard is null").select("piece", "shard", "bytes", "n"))
    loose = written(loose.withColumn("class", F.floor(F.log2(F.col("bytes") / F.col("n"))).cast("int")), "loose")
    classes = {c: (n, size) for c, n, size in loose.groupBy("class").agg(F.count("*"), F.sum("bytes")).collect()}
    fine = fine_class({c: size for c, (_, size) in classes.items()}, shards)

    stay = settled.filter("stays").select(F.col("piece").alias("_piece"), F.col("shard").alias("_shard"))
    done = rows.join(stay, (rows["piece"] == stay["_piece"]) & (rows["shard"] == stay["_shard"])).select("row", "size", "shard")
    done = written(done, "stay")
    for some, test in ((lambda c: c >= fine, F.col("class") >= fine), (lambda c: c < fine, F.col("class") < fine)):
        held = dict(done.groupBy("shard").agg(F.sum("size")).collect())
        free = [c - held.get(k, 0) for k, c in enumerate(capacity)]
        count, size = (sum(x[i] for c, x in classes.items() if some(c)) for i in (0, 1))
        placed = in_line(rows, loose.filter(test).drop("class"), count, shares(free, size))
        done = done.union(written(placed, "line"))
    return done.select("row", "shard")


def nodes(docs: DataFrame) -> DataFrame:
    """row (a number of the written row), doc_id, size, text_crc32, piece (64 bits) and hub (128) of the
    text, and o, a hash that orders rows."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("piece"),
        F.xxhash64(F.lit(1), text).alias("more"),
    )
    return narrow.withColumn("o", F.xxhash64("doc_id", "piece", "row"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text); equal texts are linked."""
    rows = written(nodes(docs), "nodes")
    groups = rows.groupBy("piece", "more").count().filter("count > 1").select("piece", "more")
    linked = rows.join(groups, ["piece", "more"], "left_semi")
    linked = written(linked.select("row", "size", F.struct("piece", "more").alias("hub"), F.pmod("o", F.lit(shards)).cast("int").alias("shard")), "linked")
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    placed, _ = propagate(linked.select("row", "size", "shard"), linked.select("row", "hub"), capacity, rounds)
    start = rows.join(placed.select("row", "shard"), "row", "left").select("row", "size", "piece", "o", "shard")
    done = evened(written(start, "start"), capacity)
    final = written(rows.select("row", "doc_id", "size", "text_crc32", "o").join(done, "row"), "final")
    counts = final.groupBy("shard").agg(F.count("*").alias("rows"))
    slots = running(final.join(counts, "shard"), ["shard"], "o", F.lit(1), F.col("rows"))
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("start").cast("bigint").alias("slot"))


def op13_label_shards(spark, folder: str) -> DataFrame:
    done = shard(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
