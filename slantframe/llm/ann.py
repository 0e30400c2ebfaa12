"""Approximate nearest neighbours by an adaptive scan of the dimensions.

Largest inner products become nearest distances by one more coordinate that
gives all vectors the same norm.  The vectors are rotated at random, so that
the distance over the first dimensions estimates the whole one with a known
error; within each probed list, candidates are scanned in blocks of columns
and dropped as soon as a hypothesis test on the partial distance says that
they are farther than the best found so far.

Lists come from k-means on a bounded sample; every row is in a list, and every
probed list is scanned whole.  How many lists are probed follows from the
recall that the sample shows.  Equal vectors are one candidate that carries
its least ids, so a vector that a third of all rows share is scanned once.
Rows lie in groups of whole lists (hot lists are cut into pieces), and a query
goes only to the groups that hold a list it probes, in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slantframe.llm.scratch import Scratch

#: Rows of the fitting sample, lists at most, k-means rounds, queries that measure recall.
SAMPLE, LISTS, ROUNDS, TRIALS = 20_000, 4096, 10, 200
#: Dimensions of a column block, and the error bound of the test in standard deviations.
BLOCK, EPSILON = 16, 2.1
#: Rows of a group of lists, and queries that meet it at a time.
ROWS, QUERIES = 16_384, 4096
#: Share of the true neighbours that the probed lists must hold in the sample.
RECALL = 0.97


@dataclass(frozen=True)
class Index:
    """Rotation, centroids and the sample that gives first bounds; all of bounded size."""

    norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    seeds: np.ndarray
    seed_lists: np.ndarray

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated rows, all of one norm."""
        rest = np.sqrt(np.maximum(0, self.norm**2 - (vectors**2).sum(axis=1)))
        return (np.hstack([vectors, rest[:, None]]) @ self.rotation).astype(np.float32)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return (np.hstack([vectors, np.zeros((len(vectors), 1))]) @ self.rotation).astype(np.float32)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """Which lists (columns) each rotated query probes."""
        near = self.nearest(queries)
        p = min(self.probes, near.shape[1])
        return near <= np.partition(near, p - 1, axis=1)[:, p - 1 : p]

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return _squares(points, self.centroids)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T))


def fit_index(sample: np.ndarray, norm: float, lists: int, neighbours: int, recall: float = RECALL, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    index = Index(norm, rotation, np.zeros((1, d), np.float32), 1, np.zeros((0, d), np.float32), np.zeros(0, dtype=np.int64))
    points = index.rows(sample)
    centroids = points[rng.choice(len(points), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squares(points, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids, dtype=np.float64)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=lists)
        centroids[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    own = _squares(points, centroids).argmin(axis=1)
    trial = rng.choice(len(points), min(TRIALS, len(points)), replace=False)
    asked = index.queries(sample[trial])
    k = min(neighbours, len(points))
    true = np.argpartition(_squares(asked, points), k - 1, axis=1)[:, :k]
    rank = _squares(asked, centroids).argsort(axis=1).argsort(axis=1)
    needed = np.sort(np.take_along_axis(rank, own[true], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    seeds = rng.choice(len(points), min(len(points), 2048), replace=False)
    return Index(norm, rotation, centroids, probes, points[seeds], own[seeds])


def scan(index: Index, vectors: np.ndarray, lists: np.ndarray, asked: np.ndarray, neighbours: int, everything: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of what survives in the lists that each query probes.

    The best ``neighbours`` rows of each query among the probed ones survive,
    but for the tests' errors; others may as well.  The first bound of a
    query is the distance of its neighbours among the sample's rows in the
    probed lists.  With everything, all lists are probed and nothing is
    tested.
    """
    rows, queries = index.rows(vectors), index.queries(asked)
    probed = index.probed(queries)
    bound = np.full(len(queries), np.inf, dtype=np.float32)
    if everything:
        probed[:] = True
    elif len(index.seeds) >= neighbours:
        seeds = np.where(probed[:, index.seed_lists], _squares(queries, index.seeds), np.float32(np.inf))
        bound = np.partition(seeds, neighbours - 1, axis=1)[:, neighbours - 1] * np.float32(1 + 1e-5)
    best = np.full((len(queries), neighbours), np.inf, dtype=np.float32)
    d = rows.shape[1]
    cuts = list(range(0, d, BLOCK)) + [d]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(lists, kind="stable")
    starts = np.flatnonzero(np.r_[True, lists[order][1:] != lists[order][:-1]])
    for a, b in zip(starts, [*starts[1:], len(order)]):
        member = order[a:b]
        who = np.flatnonzero(probed[:, lists[member[0]]])
        if not len(who):
            continue
        partial = _squares(queries[who, : cuts[1]], rows[member, : cuts[1]])
        q, x = np.nonzero(partial <= _allowed(bound[who], cuts[1], d)[:, None])
        distance = partial[q, x]
        q, x = who[q], member[x]
        for lo, hi in zip(cuts[1:-1], cuts[2:]):
            distance = distance + ((rows[x, lo:hi] - queries[q, lo:hi]) ** 2).sum(axis=1)
            alive = distance <= _allowed(bound[q], hi, d)
            q, x, distance = q[alive], x[alive], distance[alive]
        found.append((q, x))
        for i in [] if everything else np.unique(q):
            own = np.sort(np.r_[best[i], distance[q == i]])[:neighbours]
            best[i] = own
            bound[i] = min(bound[i], own[-1] * np.float32(1 + 1e-5))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(float)
    q, x = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    products = np.concatenate([np.einsum("ij,ij->i", vectors[x[i : i + 65536]], asked[q[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    return q, x, products


def _allowed(bound: np.ndarray, seen: int, d: int) -> np.ndarray:
    """The largest squared partial distance over seen of d dimensions that may still belong to a neighbour."""
    return bound if seen >= d else bound * np.float32(seen / d * (1 + EPSILON / np.sqrt(seen)) ** 2)


def _top(q: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n best of each query: largest score, then least id."""
    order = np.lexsort((ids, -score, q))
    first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < n]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


def nearest_neighbours(table: DataFrame, query: Column, neighbours: int = 20, vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest rows found for each row for which query holds.

    Nearness is the inner product, in double precision on the vectors as
    given; ties go to the smaller vec_id, and a query isn't its own candidate.
    Rows with a null id, and vectors that are null, zero, hold null or
    non-finite components or have another length than most, take no part.
    Rows equal in id and vector count once; other columns are not looked at.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    value = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select("vec_id", value.alias("v"), F.coalesce(query, F.lit(False)).alias("asks")).where("vec_id is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    key = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v")))
    rows = rows.where(F.size("v") == sizes["d"]).withColumn("cid", key)
    least = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))
    members = rows.select("cid", "vec_id", "v").distinct().withColumn("n", least).where(F.col("n") <= neighbours + 1)
    classes = scratch.save(members.groupBy("cid").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asking = scratch.save(rows.where("asks").select(F.col("vec_id").alias("query_id"), "cid").distinct())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total, most, held = classes.agg(F.count("*"), F.max(norm), F.sum(F.size("ids"))).first()
    sample = np.array([r[0] for r in classes.select("v", "cid").orderBy("cid").limit(SAMPLE).collect()])
    lists = int(np.clip(np.sqrt(total), 1, min(LISTS, max(1, len(sample) // 16))))
    shared = spark.sparkContext.broadcast(fit_index(sample, float(most), lists, neighbours + 1, recall))

    def listed(batches):
        for batch in batches:
            points = shared.value.rows(_matrix(pa.chunked_array([batch.column(1)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.nearest(points).argmin(axis=1).astype(np.int32))], ["cid", "v", "ids", "list"])

    placed = scratch.save(classes.mapInArrow(listed, "cid string, v array<double>, ids array<long>, list int"))
    asked = scratch.save(classes.select("cid", "v").join(asking.select("cid").distinct(), "cid", "left_semi"))
    groups = -(-total // ROWS)
    # A list is cut into pieces of a quarter of a group at most, and pieces are dealt to groups; there are LISTS lists at most.
    pieces = {r["list"]: int(-(-4 * r["count"] // ROWS)) for r in placed.groupBy("list").count().collect()}
    cut = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(pieces.items()) for x in pair]), F.col("list"))
    group_of = lambda piece: F.pmod(F.xxhash64("list", piece), F.lit(groups)).cast("int")
    dealt = placed.withColumn("g", group_of(F.pmod(F.xxhash64("cid"), cut.cast("long"))))

    def probing(batches):
        for batch in batches:
            who, lists = np.nonzero(shared.value.probed(shared.value.queries(_matrix(pa.chunked_array([batch.column(1)])))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(lists.astype(np.int32))], ["cid", "list"])

    def search(wanted: DataFrame, everything: bool) -> DataFrame:
        """(cid, vec_id, score): candidates of each wanted class from the groups that hold its lists."""
        if everything:
            sent = wanted.select("cid", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        else:
            lists = wanted.select("cid", "v").mapInArrow(probing, "cid string, list int").where(F.col("list").isin(list(pieces)))
            sent = lists.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), cut.cast("long") - 1))).select("cid", group_of(F.col("piece")).alias("g")).distinct()
        sent = scratch.save(sent)
        blocks = scratch.save(sent.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")))
        left = dealt.join(blocks, "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = sent.join(blocks, "g").join(wanted.select("cid", "v"), "cid").withColumn("b", F.pmod(F.xxhash64(F.lit(2), "cid"), F.col("blocks")).cast("int"))

        def meet(key, data: pa.Table, asks: pa.Table) -> pa.Table:
            if not data.num_rows or not asks.num_rows:
                return pa.table({"cid": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            q, x, score = scan(shared.value, _matrix(data.column("v")), data.column("list").to_numpy(), _matrix(asks.column("v")), neighbours + 1, everything)
            ids = data.column("ids").combine_chunks()
            first = ids.offsets.to_numpy()
            flat, n = ids.values.to_numpy(), np.diff(first)
            keep = _top(q, score, flat[first[:-1]][x], neighbours + 1)
            q, x, score = q[keep], x[keep], score[keep]
            rep = n[x]
            at = np.repeat(first[:-1][x] - (np.cumsum(rep) - rep), rep) + np.arange(rep.sum())
            q, score, found = np.repeat(q, rep), np.repeat(score, rep), flat[at]
            keep = _top(q, score, found, neighbours + 1)
            return pa.table({"cid": asks.column("cid").combine_chunks().take(pa.array(q[keep])), "vec_id": pa.array(found[keep]), "score": pa.array(score[keep])})

        return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(meet, "cid string, vec_id long, score double")

    by = lambda c: Window.partitionBy(c).orderBy(F.desc("score"), "vec_id")
    met = scratch.save(search(asked, False))
    counts = met.groupBy("cid").agg(F.count("*").alias("found"))
    lacking = scratch.save(asked.join(counts, "cid", "left").where(F.coalesce("found", F.lit(0)) < min(neighbours + 1, held)).select("cid", "v"))
    if not lacking.isEmpty():
        # The probed lists of these held too few rows; all lists are scanned for them.
        met = met.join(lacking.select("cid"), "cid", "left_anti").unionAll(search(lacking, True))
    short = met.withColumn("n", F.row_number().over(by("cid"))).where(F.col("n") <= neighbours + 1).drop("n")
    named = asking.join(short, "cid").where("vec_id <> query_id")
    ranked = named.withColumn("rank", F.row_number().over(by("query_id"))).where(F.col("rank") <= neighbours)
    return ranked.select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")
