"""Nearest neighbours by cosine over a hierarchical k-means tree that grows with the table.

The top of the tree is fitted on a bounded sample of unit vectors; every row is filed under a
leaf by descending to the nearest centroid. A leaf that then holds more than LEAF_MOST rows is
split by a tree of its own, fitted on a bounded sample of its rows in the task that holds it,
and so on: leaves stay small however large the table is, and no task and no driver holds the
whole tree.

A query visits leaves best bin first: a priority queue holds tree nodes by distance, the
nearest is opened, and leaves come out in that order; where leaves have trees of their own,
the query goes on in those and its nearest leaves of all are kept. How many leaves are visited
is calibrated: the true neighbours of some random rows are found by comparison with all rows,
and visits widen until the share of them that lies in visited leaves reaches the target. A
query whose leaves hold too few rows opens more.

Neighbouring leaves form a cell. A cell's rows are dealt into blocks of bounded size, and so
are the queries that visit any of its leaves; where two blocks meet, each query is compared
with its visited leaves only and k rows leave for it. A common vector that fills a leaf only
adds blocks.
"""

from __future__ import annotations

import heapq
import logging
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborel.scratch import materialize

log = logging.getLogger("arborel")

#: Rows the top of the tree is fitted on, children of a node, sample rows below which a node is a leaf.
SAMPLE, BRANCH, LEAF_ROWS = 32_768, 16, 64
#: Rows beyond which a leaf is split by its own tree, and about how many of them that is fitted on.
LEAF_MOST, SUB_SAMPLE = 8192, 4096
#: Share of the true neighbours that the calibrated number of visits must find, queries it is measured on, leaves that calibration looks at first.
TARGET_RECALL, CALIBRATION_QUERIES, FIRST_LOOK = 0.97, 256, 4096
#: Cells of the top's leaves at least, rows of one at most otherwise; rows, and queries, that meet in one task step.
CELLS, CELL_ROWS, BLOCK, ASK_BLOCK = 32, 16_384, 32_768, 4096
#: A leaf of the top is TOP + its number; a leaf below a leaf is that one's number times SUB, plus its own.
TOP, SUB, DEPTH = 1 << 16, 1 << 12, 3


class Tree:
    """Node centroids, children by node, and leaf numbers; node 0 is the root."""

    def __init__(self, points: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.centroids, self.children, self.leaf = [points.mean(axis=0)], [[]], [-1]
        rng, work = np.random.default_rng(seed), [(0, points)]
        n_leaves = 0
        while work:
            node, inside = work.pop()
            parts = self._split(inside, branch, leaf_rows, rng) if len(inside) > leaf_rows else []
            if len(parts) < 2:
                self.leaf[node] = n_leaves
                n_leaves += 1
                continue
            for centroid, part in parts:
                self.children[node].append(len(self.centroids))
                work.append((len(self.centroids), part))
                self.centroids.append(centroid)
                self.children.append([])
                self.leaf.append(-1)
        self.centroids = np.array(self.centroids)
        self.n_leaves = n_leaves

    @staticmethod
    def _split(points: np.ndarray, branch: int, leaf_rows: int, rng) -> list:
        k = min(branch, -(-len(points) // leaf_rows))
        centers = points[rng.choice(len(points), k, replace=False)]
        for _ in range(8):
            own = Tree.nearest(points, centers)
            used = np.unique(own)
            centers = np.array([points[own == j].mean(axis=0) for j in used])
        own = Tree.nearest(points, centers)
        return [(centers[j], points[own == j]) for j in np.unique(own)]

    @staticmethod
    def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return ((centers**2).sum(axis=1) - 2 * points @ centers.T).argmin(axis=1)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, by descent to the nearest child."""
        out = np.empty(len(points), dtype=np.int64)
        work = [(0, np.arange(len(points)))]
        while work:
            node, rows = work.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            own = self.nearest(points[rows], self.centroids[kids])
            work += [(int(kids[j]), rows[own == j]) for j in np.unique(own)]
        return out

    def visit(self, query: np.ndarray, limit: int) -> list[tuple[float, int]]:
        """(squared distance, leaf) of the first leaves that a best-bin-first traversal reaches."""
        distance = ((self.centroids - query) ** 2).sum(axis=1)
        queue, found = [(0.0, 0)], []
        while queue and len(found) < limit:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append((float(distance[node]), self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(queue, (float(distance[child]), child))
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return picked.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))


def fit_top(rows: DataFrame, sample: int = SAMPLE) -> tuple[Tree, int, list, int] | None:
    """The top tree, the vectors' length, calibration queries (id, vector) and the number of rows.

    The tree is fitted on at most `sample` rows with the smallest hashes of the id, and the
    first of those are the calibration queries. None without rows.
    """
    n = rows.count()
    if not n:
        return None
    share = min(1.0, 1.1 * sample / n)
    coin = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30))
    table = rows.where(coin < F.lit(int(share * (1 << 30)))).select("vec_id", "vector", coin.alias("coin")).limit(2 * sample).toArrow()
    if not table.num_rows:
        table = rows.select("vec_id", "vector", coin.alias("coin")).limit(sample).toArrow()
    lists = table.column("vector").to_pylist()
    lengths, counts = np.unique([len(v) for v in lists], return_counts=True)
    dim = int(lengths[counts.argmax()])
    ids = table.column("vec_id").to_numpy()
    order = np.lexsort((ids, table.column("coin").to_numpy()))
    picked = np.array([i for i in order if len(lists[i]) == dim][:sample])
    asked = list({int(ids[i]): lists[i] for i in picked[:CALIBRATION_QUERIES]}.items())
    return Tree(_unit(np.array([lists[i] for i in picked[np.argsort(ids[picked], kind="stable")]], dtype=np.float64))), dim, asked, n


def _packed(ids: list, leaves: list, distances: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves, pa.int64()), pa.array(distances, pa.float64())], schema=schema)


_ROUTES = pa.schema([("query_id", pa.int64()), ("leaf", pa.int64()), ("distance", pa.float64())])
_ROUTES_DDL = "query_id long, leaf long, distance double"


class Index:
    """Rows filed under the leaves of a top tree and of the trees below it."""

    def __init__(self, rows: DataFrame, top: Tree):
        """rows(vec_id, vector) of one length."""
        self.top, self.levels, self.recall = top, [], 0.0

        def file(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(TOP + top.assign(_unit(_matrix(batch.column(1)))))], ["vec_id", "vector", "leaf"])

        self.filed = materialize(rows.mapInArrow(file, "vec_id long, vector array<double>, leaf long"), "ann-leaves")
        self._count()
        tried = None
        for _ in range(DEPTH):
            over = self.sizes.where(F.col("n") > LEAF_MOST)
            over = over if tried is None else over.join(tried, "leaf", "left_anti")
            if over.isEmpty():
                break
            tried = over.select("leaf") if tried is None else tried.unionByName(over.select("leaf"))
            self._split(over)
        large = self.sizes.where(F.col("n") > LEAF_MOST).count()
        if large:
            log.warning("%d leaves hold more than %d rows that cannot be told apart further; they are compared in blocks", large, LEAF_MOST)

    def _count(self) -> None:
        self.sizes = materialize(self.filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "ann-sizes")

    def _split(self, over: DataFrame) -> None:
        """Give each of the leaves over(leaf, n) a tree of its own, and file its rows anew."""
        trees = pa.schema([("leaf", pa.int64()), ("tree", pa.binary())])
        moved = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("leaf", pa.int64())])

        def fit(held: pa.Table) -> pa.Table:
            tree = Tree(_unit(_matrix(held.column("vector").combine_chunks())))
            rows = [(held.column("leaf")[0].as_py(), pickle.dumps(tree))] if 1 < tree.n_leaves <= SUB else []
            return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary()))], schema=trees)

        def assign(held: pa.Table, own: pa.Table) -> pa.Table:
            if not held.num_rows or not own.num_rows:
                return moved.empty_table()
            tree = pickle.loads(own.column("tree")[0].as_py())
            leaf = held.column("leaf").to_numpy() * SUB + tree.assign(_unit(_matrix(held.column("vector").combine_chunks())))
            return pa.table([held.column("vec_id"), held.column("vector"), pa.array(leaf)], schema=moved)

        coin = F.pmod(F.xxhash64("vec_id", F.lit("split")), F.lit(1 << 30))
        sample = self.filed.join(over, "leaf").where(coin < F.lit(float(1 << 30)) * SUB_SAMPLE / F.col("n")).select("leaf", "vector")
        below = materialize(sample.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"), "ann-trees")
        parts = materialize(over.join(below.select("leaf"), "leaf").select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "ann-parts")
        left = self.filed.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "vector")
        right = below.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tree")
        again = left.repartition("leaf", "part").groupBy("leaf", "part").cogroup(right.repartition("leaf", "part").groupBy("leaf", "part"))
        again = again.applyInArrow(assign, "vec_id long, vector array<double>, leaf long")
        self.filed = materialize(self.filed.join(parts, "leaf", "left_anti").select("vec_id", "vector", "leaf").unionByName(again), "ann-leaves")
        self.levels.append(below)
        self._count()

    def routes(self, asked: DataFrame, most: int) -> DataFrame:
        """(query_id, leaf, distance, n, place) of the `most` nearest leaves of each row of asked(query_id, vector), from place 1 on; n is the leaf's rows."""
        top = self.top

        def start(batches):
            for batch in batches:
                out: list[list] = [[], [], []]
                for query_id, unit in zip(batch.column(0).to_pylist(), _unit(_matrix(batch.column(1))) if batch.num_rows else ()):
                    for distance, leaf in top.visit(unit, most):
                        for column, value in zip(out, (query_id, TOP + leaf, distance), strict=True):
                            column.append(value)
                yield _packed(*out, _ROUTES)

        def go_on(asks: pa.Table, own: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            if asks.num_rows and own.num_rows:
                tree, leaf = pickle.loads(own.column("tree")[0].as_py()), own.column("leaf")[0].as_py()
                for query_id, unit in zip(asks.column("query_id").to_pylist(), _unit(_matrix(asks.column("vector").combine_chunks())), strict=True):
                    for distance, sub in tree.visit(unit, most):
                        for column, value in zip(out, (query_id, leaf * SUB + sub, distance), strict=True):
                            column.append(value)
            return pa.Table.from_batches([_packed(*out, _ROUTES)])

        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "leaf"))
        found = asked.mapInArrow(start, _ROUTES_DDL)
        for below in self.levels:
            found = materialize(found, "ann-routes")
            hit = found.join(below.select("leaf"), "leaf", "left_semi")
            parts = materialize(hit.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ASK_BLOCK).cast("int").alias("parts")), "ann-parts")
            left = hit.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id").join(asked, "query_id")
            right = below.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tree")
            opened = left.repartition("leaf", "part").groupBy("leaf", "part").cogroup(right.repartition("leaf", "part").groupBy("leaf", "part")).applyInArrow(go_on, _ROUTES_DDL)
            found = found.join(below.select("leaf"), "leaf", "left_anti").select("query_id", "leaf", "distance").unionByName(opened)
            found = found.withColumn("place", place).where(F.col("place") <= most).drop("place")
        return found.join(self.sizes, "leaf").withColumn("place", place)

    def calibrate(self, queries: list, k: int, target: float) -> int:
        """Leaves to visit so that the target share of the queries' true k nearest, found among all rows, lies in them.

        Looks at the FIRST_LOOK nearest leaves of a query, and at four times as many as long as
        the target is not reached in them, up to all.
        """
        ids = np.array([i for i, _ in queries])
        units = _unit(np.array([v for _, v in queries], dtype=np.float64))
        schema = pa.schema([("query_id", pa.int64()), ("leaf", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])

        def nearest(batches):
            best = [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.float64, np.int64)]  # query, leaf, score, vec_id
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                score = units @ _unit(_matrix(batch.column(1))).T
                score[vec[None] == ids[:, None]] = -np.inf
                top = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                query = np.repeat(np.arange(len(ids)), top.shape[1])
                rows = top.ravel()
                best = [np.concatenate(p) for p in zip(best, (query, leaf[rows], score[query, rows], vec[rows]), strict=True)]
                order = np.lexsort((best[3], -best[2], best[0]))
                at = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
                best = [b[order[at < k]] for b in best]
            sure = best[2] > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0][sure]], pa.int64()), *(pa.array(b[sure]) for b in best[1:])], schema=schema)

        found = self.filed.mapInArrow(nearest, "query_id long, leaf long, score double, vec_id long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        true = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k), "ann-true")
        asked = self.filed.sparkSession.createDataFrame(queries, "query_id long, vector array<double>")
        leaves, look = self.sizes.count(), FIRST_LOOK
        while True:
            seen = true.join(self.routes(asked, look), ["query_id", "leaf"], "left")
            # k rows for each calibration query; a neighbour outside of the leaves looked at has no place
            places = sorted(math.inf if r.place is None else r.place for r in seen.select("place").collect())
            visits = places[math.ceil(target * len(places)) - 1] if places else 1
            if visits < math.inf:
                self.recall = sum(p <= visits for p in places) / max(1, len(places))
                return visits
            if look >= leaves:
                raise RuntimeError(f"true neighbours lie outside of all {leaves} leaves")
            look *= 4


def search(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = TARGET_RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds.

    Candidates are all rows but the query's own id. Scores are cosines of the original
    vectors in double precision; ties go to the smaller id. Rows with a null id, a null,
    empty or zero vector, null or non-finite components, or another length than most of the
    sample's take no part. Only with fewer candidates than k are fewer given. Repeated vectors
    are candidates of their own, and so are rows that repeat an id, but for the query's; an id
    with several rows asks with the smallest of its vectors. Other columns are not read.

    Leaves are opened until the calibration queries' recall, measured against all rows, reaches
    `recall`. A leaf stays larger than LEAF_MOST where its rows are equal or lie DEPTH trees
    deep; that costs time, as all of a visited leaf is compared in blocks, and no neighbours.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    fitted = fit_top(rows, sample)
    if fitted is None:
        return spark.createDataFrame([], schema)
    top, dim, queries, n = fitted
    rows = rows.where(F.size("vector") == dim)
    index = Index(rows, top)
    visits = index.calibrate(queries, k, recall)
    log.info("a query visits %d leaves of %d in the top and %d levels below it: recall %.3f", visits, top.n_leaves, len(index.levels), index.recall)

    # every leaf holds a row, so k + 1 more than the visits are enough for a query to find k others
    asked = rows.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = materialize(asked, "ann-asked")
    ahead = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    routes = index.routes(asked, visits + k + 1).withColumn("held", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    routes = routes.where((F.col("place") <= visits) | (F.col("held") <= k))
    cells = min(top.n_leaves, max(CELLS, -(-n // CELL_ROWS)))
    # leaves of the top lie side by side where their numbers do, other leaves below one leaf
    cell = F.when(F.col("leaf") < 2 * TOP, -1 - F.floor((F.col("leaf") - TOP) * cells / top.n_leaves)).otherwise(F.floor(F.col("leaf") / SUB)).cast("long")
    visited = routes.withColumn("cell", cell).groupBy("query_id", "cell").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    visited = materialize(visited.join(asked, "query_id"), "ann-visits")
    filed = index.filed.withColumn("cell", cell)
    count = lambda df, block, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = materialize(count(filed, BLOCK, "n_rows").join(count(visited, ASK_BLOCK, "n_queries"), "cell"), "ann-blocks")
    keys = ["cell", "part", "ask"]
    left = filed.join(blocks, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("n_rows")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("n_queries") - 1)).alias("ask"), "vec_id", "vector", "leaf",
    )
    right = visited.join(blocks, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("part"),
        F.pmod(F.xxhash64("query_id"), F.col("n_queries")).cast("int").alias("ask"), "query_id", "vector", "leaves",
    )
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return out.empty_table()
        held = held.sort_by("leaf")
        ids, leaf, points = held.column("vec_id").to_numpy(), held.column("leaf").to_numpy(), _matrix(held.column("vector").combine_chunks())
        units, wanted = _unit(points), _matrix(asked.column("vector").combine_chunks())
        found: list[list] = [[], [], []]
        for query_id, query, unit, leaves in zip(asked.column("query_id").to_pylist(), wanted, _unit(wanted), asked.column("leaves").to_pylist(), strict=True):
            ranges = zip(np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, side="right"), strict=True)
            rows = np.concatenate([np.arange(a, b) for a, b in ranges])
            rows = rows[ids[rows] != query_id]
            near = units[rows] @ unit
            floor = np.partition(near, -k)[-k] if len(near) > k else -np.inf
            rows = rows[near >= floor - 1e-9]
            score = cosine(points[rows], query)
            order = np.lexsort((ids[rows], -score))[:k]
            for column, values in zip(found, ([query_id] * len(order), ids[rows][order], score[order]), strict=True):
                column.extend(values)
        return pa.table(found, schema=out)

    # dealt by all three keys: by the cell alone, all its blocks would meet in one task
    pairs = left.repartition(*keys).groupBy(*keys).cogroup(right.repartition(*keys).groupBy(*keys))
    near = pairs.applyInArrow(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each row's sum has one order, so equal vectors tie exactly."""
    dots = (points * query).sum(axis=1)
    return dots / (np.sqrt((points * points).sum(axis=1)) * np.sqrt((query * query).sum()))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 50 == 0)
