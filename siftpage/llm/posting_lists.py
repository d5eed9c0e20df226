"""Approximate nearest neighbours by balanced posting lists.

The heads of the lists are a sample of the different vectors: one for each `ROWS_PER_HEAD`, so that lists
are as dense as the vectors and stay short as the table grows, at most `HEADS`, as many as a worker's
memory holds; beyond, lists grow and are split. A graph that ties each head to its nearest ones is
searched in memory: from some entry heads on, the nearest heads that are not yet expanded are, until all
of the best that were asked for are. Every vector is filed under its nearest head, and under each
further one whose distance is within `CLOSURE` of the nearest, `REPLICAS` in all, so that vectors at a
boundary are found from both sides. A query looks up its nearest heads in the graph, drops those whose
distance is above a ratio of the nearest one's, and compares itself exactly with what is filed under the
others. How many heads and what ratio are measured at each fit: held-out queries are compared with a whole
sample, and searched for by the same graph, so that what the graph misses counts; the lists taken must
hold the share `RECALL` of the neighbours. Neighbours in a sample lie farther off than those in the
table, so the numbers err to the high side.

Nearness is the cosine; graph and lists work on vectors of length one, the scores on the originals
in double precision. Equal vectors are one entry with their smallest ids, as many as can appear in a
result, so that copies make no list long. A list still above `LIST_ROWS` entries is split, and so are
the queries of a list; each group of such pieces hands on the best `top` of a query.

Defined results: null vectors, and such with no or with null or non-finite components or of length
zero, take no part; vectors of several lengths are searched each among those of the most frequent length
only, others take no part; ties go to the smaller id; with fewer candidates than `top` all are returned;
repeated rows (one id, one vector) are candidates once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftpage.llm.common import table, written

#: Vectors for each head, and bounds of the fit: heads, rows of the sample that measures, held-out queries.
ROWS_PER_HEAD, HEADS, FIT_ROWS, HELD = 8, 65_536, 40_000, 400
REPLICAS, CLOSURE = 8, 1.3
#: Neighbours of a head in the graph (as many again lead back), entry heads, heads expanded at once, the
#: narrowest search, and the most lists of a query.
DEGREE, ENTRIES, AT_ONCE, WIDE, WIDEST = 20, 256, 8, 32, 384
#: Share of the true neighbours that the searched lists must hold, and what of it the ratio may cost.
RECALL, PRUNED = 0.97, 0.01
LIST_ROWS, QUERY_ROWS, GROUP_ROWS = 4_000, 1_000, 20_000
BATCH = 128


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors_of(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


class Index:
    """Heads (unit vectors), the graph that ties them, and how far a query's search goes."""

    def __init__(self, heads: np.ndarray, graph: np.ndarray):
        self.heads, self.graph = heads, graph
        self.entries = np.linspace(0, len(heads) - 1, min(ENTRIES, len(heads))).astype(np.int64)
        self.lists, self.ratio = len(heads), np.inf

    def search(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query (unit rows) the heads nearest to it that the graph leads to, nearest first, and
        their distances; -1 and infinity where there are no more."""
        wide = min(len(self.heads), max(most + most // 4, WIDE))
        ids, far = np.empty((len(q), min(most, len(self.heads))), np.int64), np.empty((len(q), min(most, len(self.heads))))
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH].astype(np.float32)
            found, close = self.beam(part, wide)
            ids[at : at + BATCH], far[at : at + BATCH] = found[:, : ids.shape[1]], close[:, : ids.shape[1]]
        return ids, far

    def beam(self, q: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))[:, None]
        met = np.zeros((n, len(self.heads) + 1), bool)
        met[:, self.entries] = met[:, -1] = True
        pool = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        close = q @ self.heads[self.entries].T
        done = np.zeros(pool.shape, bool)
        while True:
            order = np.argsort(-close, axis=1, kind="stable")[:, :wide]
            pool, close, done = (np.take_along_axis(x, order, 1) for x in (pool, close, done))
            # the nearest heads that are not expanded yet
            rank = np.where(done | (pool < 0), wide, np.arange(pool.shape[1])[None, :])
            pick = np.argsort(rank, axis=1, kind="stable")[:, : max(AT_ONCE, wide // 16)]
            fresh = np.take_along_axis(rank, pick, 1) < wide
            if not fresh.any():
                return pool, np.sqrt(np.maximum(0, 2 - 2 * close))
            np.put_along_axis(done, pick, True, 1)
            new = self.graph[np.where(fresh, np.take_along_axis(pool, pick, 1), -1)]
            new[~fresh] = -1
            new = np.sort(new.reshape(n, -1), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[met[rows, new]] = -1
            met[rows, new] = True
            # only columns that hold something for some query
            new = new[:, (new >= 0).any(0)]
            score = np.matmul(self.heads[new], q[:, :, None])[:, :, 0] if new.size else np.zeros(new.shape, np.float32)
            score[new < 0] = -np.inf
            pool, close = np.concatenate([pool, new], 1), np.concatenate([close, score], 1)
            done = np.concatenate([done, new < 0], 1)

    def filed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each list that a vector is filed under."""
        ids, far = self.search(x, REPLICAS)
        row, column = np.nonzero((far <= CLOSURE * far[:, :1] + 1e-6) & (ids >= 0))
        return row, ids[row, column]

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each list that a query searches."""
        ids, far = self.search(q, self.lists)
        row, column = np.nonzero((far <= self.ratio * far[:, :1] + 1e-6) & (ids >= 0))
        return row, ids[row, column]

    def measure(self, x: np.ndarray, top: int, seed: int = 5) -> None:
        """Set how many lists a query searches and within what ratio, by the neighbours in a sample x."""
        top = min(top, len(x) - 1)
        if top < 1:
            return
        asked = np.random.default_rng(seed).permutation(len(x))[:HELD]
        best = np.empty((len(asked), top), np.int64)
        for at in range(0, len(asked), 64):
            rows = asked[at : at + 64]
            close = x[rows] @ x.T
            close[np.arange(len(rows)), rows] = -np.inf
            best[at : at + 64] = np.argpartition(-close, top - 1, axis=1)[:, :top]
        wanted, back = np.unique(best, return_inverse=True)
        row, lists = self.filed(x[wanted])
        of = [set(lists[row == i].tolist()) for i in range(len(wanted))]
        ids, far = self.search(x[asked], min(WIDEST, len(self.heads)))
        needed, ratios = [], []
        for i, own in enumerate(back.reshape(best.shape).tolist()):
            for w in own:
                place = next((k for k, h in enumerate(ids[i].tolist()) if h in of[w]), None)
                needed.append(ids.shape[1] if place is None else place)
                ratios.append(np.inf if place is None else far[i, place] / max(far[i, 0], 1e-6))
        needed, ratios = np.array(needed), np.array(ratios)
        self.lists = int(min(np.sort(needed)[int(np.ceil(RECALL * len(needed))) - 1] + 1, ids.shape[1]))
        held = np.sort(ratios[needed < self.lists])
        if len(held):
            self.ratio = float(held[int(np.ceil((1 - PRUNED) * len(held))) - 1])


def class_of(v: Column) -> Column:
    """128 bits of hash of a vector, so that different vectors are never taken for one."""
    return F.concat(F.hex(F.xxhash64(v)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), v)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part, each (id, vector) once."""
    v = F.col("embedding").cast("array<double>")
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fit & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0)).distinct()


def classes(rows: DataFrame, top: int) -> DataFrame:
    """class, v, ids: each different vector with its `top` + 1 smallest ids."""
    numbered = rows.withColumn("class", class_of(F.col("v"))).withColumn(
        "n", F.row_number().over(Window.partitionBy("class", "v").orderBy("vec_id"))
    )
    first = numbered.filter(F.col("n") <= top + 1)
    return first.groupBy("class", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit(distinct: DataFrame, top: int) -> Index | None:
    """Heads from a sample of the different vectors, their graph, and how far a search goes.

    The sample that measures is drawn from the other end of the hash, so that in a table of more than
    both no head is in it.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    if not count:
        return None
    place = F.xxhash64(F.lit(3), "class") / F.lit(2.0**64) + 0.5

    def sample(inside: Column) -> np.ndarray:
        rows = distinct.filter(inside).select("v").toPandas()["v"]
        if not len(rows):
            rows = distinct.limit(FIT_ROWS).select("v").toPandas()["v"]
        x = unit(vectors_of(rows))
        return x[np.lexsort(x.T)]

    heads = sample(place <= min(HEADS, count / ROWS_PER_HEAD) / count).astype(np.float32)
    # those of one direction are one head
    heads = np.unique(heads, axis=0)
    degree = min(DEGREE, len(heads) - 1)

    def tied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for at in range(0, len(ids), 256):
                own = ids[at : at + 256]
                close = heads[own] @ heads.T
                close[np.arange(len(own)), own] = -np.inf
                near = np.argpartition(-close, degree - 1, axis=1)[:, :degree]
                yield pd.DataFrame({"id": own, "near": list(near)})

    graph = np.full((len(heads), max(1, degree)), -1, np.int64)
    if degree > 0:
        parts = max(1, len(heads) // 1024)
        ties = spark.range(0, len(heads), 1, parts).mapInPandas(tied, "id bigint, near array<bigint>").toPandas()
        graph[ties["id"].to_numpy()] = np.stack(ties["near"].to_list())
    index = Index(heads, with_ways_back(graph))
    share = FIT_ROWS / count
    index.measure(sample(place > 1 - share if share < 1 else F.lit(True)), top)
    return index


def with_ways_back(graph: np.ndarray) -> np.ndarray:
    """The graph with as many reverse ties again: a head that is nobody's neighbour could not be reached."""
    n, degree = graph.shape
    to, start = graph.ravel(), np.repeat(np.arange(n), degree)
    keep = to >= 0
    to, start = to[keep], start[keep]
    order = np.argsort(to, kind="stable")
    to, start = to[order], start[order]
    nth = np.arange(len(to)) - np.searchsorted(to, to)
    back = np.full((n, degree), -1, np.int64)
    few = nth < degree
    back[to[few], nth[few]] = start[few]
    # who has more followers than places points to some of them; its own ties lead on
    return np.concatenate([graph, back], 1)


def listed(distinct: DataFrame, index: Index, columns: str, queries: bool = False) -> DataFrame:
    """Each row once for each list it is filed under or, as a query, searches: list, and its own columns."""
    names = [c.split()[0] for c in columns.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                b = batch.iloc[at : at + BATCH]
                x = unit(vectors_of(b["v"]))
                row, lists = index.asked(x) if queries else index.filed(x)
                yield pd.DataFrame({"list": lists} | {n: b[n].to_numpy()[row] for n in names})

    return distinct.select(*names).mapInPandas(each, f"list bigint, {columns}")


def split(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """Adds `name`, the part of its list that a row is in: parts hold about `most` rows."""
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(f"{name}s"))
    return rows.join(parts, "list").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int"))


def best_of(queries: pd.DataFrame, members: pd.DataFrame, top: int) -> Iterator[tuple[str, int, float]]:
    """For each query the best members of one part of a list: entries whose ids hold `top` + 1 ids.

    An entry has up to `top` + 1 ids, of which one may be the query's own, so the `top` + 1 best
    entries suffice, and all that tie with the last of them. One product of matrices says which; their
    scores are then made from the original vectors.
    """
    m, q = vectors_of(members["v"]), vectors_of(queries["v"])
    norms, lengths = np.linalg.norm(m, axis=1), np.linalg.norm(q, axis=1)
    ids, names = members["ids"].to_numpy(), queries["class"].to_numpy()
    rough = (q / lengths[:, None]) @ (m / norms[:, None]).T
    if rough.shape[1] > top + 1:
        least = np.partition(rough, rough.shape[1] - top - 1, axis=1)[:, rough.shape[1] - top - 1]
    else:
        least = np.full(len(q), -np.inf)
    for i in range(len(q)):
        hit = np.flatnonzero(rough[i] >= least[i] - 1e-9)
        score = (m[hit] * q[i]).sum(1) / (norms[hit] * lengths[i])
        pairs = sorted((-s, x) for s, h in zip(score.tolist(), hit.tolist(), strict=True) for x in ids[h])[: top + 1]
        yield from ((names[i], x, -s) for s, x in pairs)


def best_of_group(queries: pd.DataFrame, members: pd.DataFrame, top: int) -> pd.DataFrame:
    """The best of each query in all lists of a group."""
    key = ["list", "part", "block"]
    own = dict(iter(queries.groupby(key)))
    found = [x for k, m in members.groupby(key) if k in own for x in best_of(own[k], m, top)]
    rows = pd.DataFrame(found, columns=["class", "vec_id", "score"]).drop_duplicates(["class", "vec_id"])
    rows = rows.sort_values(["class", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return rows.groupby("class", sort=False).head(top + 1)


def compared(queries: DataFrame, members: DataFrame, top: int) -> DataFrame:
    """class, vec_id, score: the best of each query class (list, class, v) among the members of its lists."""
    m, q = split(members, "class", LIST_ROWS, "part"), split(queries, "class", QUERY_ROWS, "block")
    # a list's parts meet its blocks, each pair in one task; both numbers are 1 for all but hot lists
    sizes = m.select("list", "parts").distinct().join(q.select("list", "blocks").distinct(), "list")
    blocks, parts = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("blocks", "parts"))
    m = m.drop("parts").join(sizes.select("list", "blocks"), "list").withColumn("block", blocks)
    q = q.drop("blocks").join(sizes.select("list", "parts"), "list").withColumn("part", parts)
    groups = max(1, -(-members.count() // GROUP_ROWS))
    key = F.pmod(F.xxhash64("list", "part", "block"), F.lit(groups)).alias("group")
    return (
        q.select(key, "list", "part", "block", "class", "v")
        .groupBy("group")
        .cogroup(m.select(key, "list", "part", "block", "v", "ids").groupBy("group"))
        .applyInPandas(lambda a, b: best_of_group(a, b, top), "class string, vec_id bigint, score double")
        .groupBy("class", "vec_id")
        .agg(F.max("score").alias("score"))
    )


def nearest(vectors: DataFrame, is_query, top: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of each row that is a query."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    distinct = written(classes(rows, top), "classes")
    model = fit(distinct, top)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if model is None:
        return empty
    asked = rows.filter(is_query).select("vec_id", class_of(F.col("v")).alias("class"), "v")
    wanted = asked.select("class", "v").distinct()
    members = listed(distinct, model, "class string, v array<double>, ids array<bigint>")
    queries = listed(wanted, model, "class string, v array<double>", queries=True)
    members, queries = written(members, "lists"), written(queries, "asked")
    found = compared(queries, members, top)
    # a query whose lists hold fewer than it must return is compared with all lists
    total = distinct.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    found = written(found, "found")
    enough = found.groupBy("class").count().filter(F.col("count") >= min(top + 1, total))
    short = wanted.join(enough, "class", "left_anti")
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(model.heads) - 1).cast("bigint")))
        found = found.join(enough, "class", "left_semi").unionByName(compared(short.withColumn("list", every), members, top))
    order = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top + 1)
    answers = best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    # a query's own id is taken out of its vector's list
    own = asked.join(answers, "class").select(
        F.col("vec_id").alias("query_id"), F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")).alias("found")
    )
    return own.select("query_id", F.posexplode(F.slice("found", 1, top)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )


def op9_nearest_neighbours(spark, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
