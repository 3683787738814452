"""Approximate nearest neighbours: an NN-descent graph and greedy graph search.

The graph has the `degree` nearest neighbours found for each distinct vector. It starts from the leaves of a
small random-projection forest; a round joins every node with the neighbours of its neighbours (in both
directions) and keeps what is nearer. Queries walk the graph from a frontier: the best unexpanded nodes of a
beam are joined with their neighbours, hop by hop. Every distance, in leaves, rounds and walk, is measured on
the original values in double precision. Nodes are numbered along a tree, so that a block of numbers is a
neighbourhood: a round sends a block each vector that its nodes' neighbours need once, not once an edge.
That is a row for each block in which a node joins the vector: on average `degree` rows a vector and round at
most, fewer while there are fewer blocks. A tree's leaves take one row a vector at any size; so leaves are
large, all their pairs are compared, and few rounds are left to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, saved
from .forest import count_leaves, is_float, plant, reached, route, split_large, stacked, usable

EDGE = "u long, v long, d double"
#: Nodes whose neighbours a round joins in one group, at most; a power of two.
BLOCK = 1 << 12


def _matrix(packed, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1)


def _banded(x: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Squared distances of the rows to all, some rows at a time; those that a product of matrices can't tell from rounding are summed from differences."""
    x = x.astype("f8")
    x -= x.mean(axis=0)
    norm = np.einsum("ij,ij->i", x, x)
    for a in range(0, len(x), rows):
        y = x[a : a + rows]
        d = norm[a : a + rows, None] + norm[None, :] - 2.0 * (y @ x.T)
        d[np.arange(len(y)), np.arange(a, a + len(y))] = np.inf
        i, j = np.nonzero(d < 1e-9 * norm.max())
        for at in range(0, len(i), 20_000):
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            d[p, q] = ((y[p] - x[q]) ** 2).sum(axis=1)
        yield np.maximum(d, 0)


def _distances(x: np.ndarray) -> np.ndarray:
    return next(_banded(x, len(x)))


def _nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite entries of each row."""
    k = min(k, d.shape[1])
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(d)), k)
    at = at.ravel()
    fine = np.isfinite(d[row, at])
    return row[fine], at[fine]


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest v of each u, repeats once. Spark keeps the k best of each u in every map task before the exchange, so a hub brings k rows a task, not all its edges.

    An edge found in two groups has distances that differ in their last bits; as floats they are one, and take one place.
    """
    turn = F.dense_rank().over(W.partitionBy("u").orderBy("d", "v"))
    best = edges.withColumn("d", F.col("d").cast("float").cast("double")).withColumn("i", turn).filter(F.col("i") <= k)
    return best.groupBy("u", "v").agg(F.min("d").alias("d"), *([F.max("old").alias("old")] if "old" in edges.columns else []))


def _same(x: np.ndarray) -> np.ndarray:
    return x


class NeighbourGraph:
    """The index of a table (vec_id, embedding).

    Equal vectors are one node; `members` has who stands behind it. Nodes: nothing is left out or sampled;
    `sample` bounds only what the upper parts of the starting forest are fitted on. Leaves that are large
    split on (forest.split_large), so they are of one size however many nodes there are. The degree is
    bounded: in either direction a node keeps its nearest; that makes the graph approximate, as NN-descent
    is. Rounds, two at least, go on until less than `settled` of the edges are new, `rounds` at most. Rows whose id or
    vector is null, empty, zero or has null or non-finite components take no part; vectors of one length are
    neighbours of none of another. An empty table gives an empty graph.
    """

    def __init__(self, embeddings: DataFrame, degree: int = 32, rounds: int = 8, trees: int = 8, leaf: int = 2400, sample: int = 16384, settled: float = 0.1, seed: int = 23):
        self.spark, self.degree, self.seed = embeddings.sparkSession, degree, seed
        #: How a component is packed: as it stands.
        self.kind = "f4" if is_float(embeddings) else "f8"
        fine = usable(embeddings)
        first = saved(fine.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "distinct")
        rows = first.count()
        planted, self.sizes = plant(first, trees, leaf, seed, sample, _same)
        self.forest = self.spark.sparkContext.broadcast(planted)
        self.vectors = saved(self._numbered(first), "vectors")
        self.members = saved(fine.join(self.vectors, "v").select("id", "vec_id").distinct(), "members")
        self.points = saved(self._packed(), "points")
        self.graph = saved(self._start(leaf, degree // 2 if rows > leaf else degree), "graph")
        #: New edges of each round, as a share.
        self.changes: list[float] = []
        for _ in range(rounds if rows > leaf else 0):
            last, self.graph = self.graph, self._round()
            forget(last)
            edges, kept = self.graph.agg(F.count("*"), F.count_if("old")).first()
            self.changes.append((edges - kept) / max(1, edges))
            if len(self.changes) > 1 and self.changes[-1] < settled:
                break

    def _numbered(self, first: DataFrame) -> DataFrame:
        """(id, v): numbers whose blocks (see BLOCK) hold nodes of neighbouring leaves of the first tree."""
        forest, base, together, after = self.forest, {}, {}, 0
        for d, n in sorted(self.sizes.items()):
            leaves = count_leaves(forest.value[d][0])
            together[d] = max(1, round(leaves * (3 * BLOCK // 4) / n))
            base[d], after = after, after + leaves // together[d] + 1

        def homed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                home, sizes = np.zeros(len(pdf), "i8"), pdf["v"].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
                for d in np.unique(sizes):
                    at = np.nonzero(sizes == d)[0]
                    row, _, number = route(stacked(pdf["v"].iloc[at]), forest.value[int(d)][:1], 0.0)
                    home[at[row]] = base[int(d)] + number // together[int(d)]
                if len(pdf):
                    yield pdf.assign(home=home)

        placed = first.select("vec_id", "v").mapInPandas(homed, "vec_id long, v array<double>, home long")
        at = F.row_number().over(W.partitionBy("home").orderBy("vec_id")) - 1
        return placed.select((F.shiftleft("home", 40) + at).alias("id"), "v")

    def _packed(self) -> DataFrame:
        kind = self.kind

        def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    yield pd.DataFrame({"id": pdf["id"], "x": [np.asarray(v, kind).tobytes() for v in pdf["v"]]})

        return self.vectors.select("id", "v").mapInPandas(packed, "id long, x binary")

    def _start(self, leaf: int, each: int) -> DataFrame:
        forest, kind, degree, limit = self.forest, self.kind, self.degree, 2 * leaf

        def routed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    row, name = reached(pdf["v"], forest.value, 0.0, _same)
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "leaf": name, "done": False})

        def met(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", ignore_index=True)
            ids, got, base = pdf["id"].to_numpy(), [], 0
            for d in _banded(_matrix(pdf["x"], kind), 512):
                row, at = _nearest(d, each)
                got.append((ids[base + row], ids[at], d[row, at]))
                base += len(d)
            return pd.DataFrame(dict(zip("uvd", map(np.concatenate, zip(*got)))))

        leaves = saved(self.vectors.select("id", "v").mapInPandas(routed, "id long, leaf long, done boolean"), "leaves")
        leaves = split_large(leaves, self.vectors.select("id", "v"), limit, leaf, 0.0, self.seed, _same)
        # Only leaves that no cut divides are still over the limit; those are dealt into parts.
        full = leaves.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / limit).cast("long").alias("parts"))
        dealt = leaves.join(full, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).join(self.points, "id")
        return _best(dealt.groupBy("leaf", "part").applyInPandas(met, EDGE), degree)

    def _round(self) -> DataFrame:
        graph = self.graph.select("u", "v", "d")
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
        block = F.shiftright("u", BLOCK.bit_length() - 1)
        near = saved(_best(both, self.degree).select(block.alias("b"), "u", "v"), "near")
        worst = graph.groupBy("u").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
        node = self.points.join(worst.withColumnRenamed("u", "id"), "id", "left")
        degree, kind = self.degree, self.kind

        def joined(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            edges, nodes = edges.sort_values(["u", "v"]), nodes.sort_values("id", ignore_index=True)
            x, ids = _matrix(nodes["x"], kind), nodes["id"].to_numpy()
            limit = np.where(nodes["n"].fillna(0).to_numpy() < degree, np.inf, nodes["worst"].fillna(np.inf).to_numpy())
            u, v = edges["u"].to_numpy(), np.searchsorted(ids, edges["v"].to_numpy())
            cuts = np.append(np.nonzero(np.diff(u, prepend=u[0] - 1))[0], len(u))
            out, got = [], []
            for a, b in zip(cuts, cuts[1:]):
                at = v[a:b]
                d = _distances(x[at])
                d[d >= limit[at, None]] = np.inf
                row, to = _nearest(d, 10)
                out.append((ids[at[row]], ids[at[to]], d[row, to]))
                if len(out) == 500 or b == len(u):
                    got.append(pd.DataFrame(dict(zip("uvd", map(np.concatenate, zip(*out))))).drop_duplicates(["u", "v"]))
                    out = []
            return pd.concat(got).drop_duplicates(["u", "v"])

        needed = near.select(F.col("b").alias("to"), F.col("v").alias("id")).distinct().join(node, "id")
        found = near.groupBy("b").cogroup(needed.groupBy("to")).applyInPandas(joined, EDGE)
        out = saved(_best(graph.withColumn("old", F.lit(True)).unionByName(found.withColumn("old", F.lit(False))), degree), "graph")
        forget(near)
        return out

    def search(self, queries: DataFrame, k: int = 10, beam: int = 256, width: int = 128, sure: int = 128, hops: int = 30) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found of each row (vec_id) of queries, a part of the indexed table.

        The walk starts at the query's own node and goes on until each of the `sure` nearest of every beam has
        been expanded, `hops` hops at most. A node's copies are expanded at the end, the smallest ids first.
        Queries that take no part in the graph have no row; fewer candidates than k give fewer rows.
        """
        asked = queries.select(F.col("vec_id").alias("query_id")).distinct().join(self.members.withColumnRenamed("vec_id", "query_id"), "query_id").withColumnRenamed("id", "q")
        starts = saved(asked.select("q").distinct(), "queries")
        own = starts.join(self.points.withColumnRenamed("id", "q"), "q").select("q", F.col("x").alias("y"))
        kind = self.kind
        around = self.graph.select("u", "v").unionByName(self.graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        around = saved(around, "around")

        @F.pandas_udf("double")
        def apart(x: pd.Series, y: pd.Series) -> pd.Series:
            out, size = np.zeros(len(x)), x.map(len).to_numpy()
            for n in np.unique(size):
                at = np.nonzero(size == n)[0]
                gap = _matrix(x.iloc[at], kind).astype("f8") - _matrix(y.iloc[at], kind)
                out[at] = np.einsum("ij,ij->i", gap, gap)
            return pd.Series(out)

        order = W.partitionBy("q").orderBy("d", "v")

        def ranked(state: DataFrame) -> DataFrame:
            """The beam: i is the place in it, go tells what the next hop expands."""
            state = state.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= beam)
            return saved(state.withColumn("go", ~F.col("done") & (F.count_if(~F.col("done")).over(order) <= width)), "beam")

        state = ranked(starts.select("q", F.col("q").alias("v"), F.lit(0.0).alias("d"), F.lit(False).alias("done")))
        for hop in range(hops):
            seen = state.filter("go").join(around.withColumnRenamed("v", "w"), F.col("v") == F.col("u")).select("q", F.col("w").alias("v")).distinct()
            seen = seen.join(state.select("q", "v"), ["q", "v"], "left_anti")
            seen = seen.join(self.points, F.col("v") == F.col("id")).join(own, "q").select("q", "v", apart("x", "y").alias("d"), F.lit(False).alias("done"))
            last, state = state, ranked(state.select("q", "v", "d", (F.col("done") | F.col("go")).alias("done")).unionByName(seen))
            forget(last)
            self.hops = hop + 1
            if state.filter(~F.col("done") & (F.col("i") <= sure)).isEmpty():
                break
        state = state.select("q", "v", "d")
        exact = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e))
        #: With all that stand level with the last one: ties go by vec_id, not by node.
        close = state.withColumn("i", F.rank().over(W.partitionBy("q").orderBy("d"))).filter(F.col("i") <= 4 * k + 1)
        close = close.join(self.vectors.select(F.col("id").alias("v"), F.col("v").alias("x")), "v").join(self.vectors.select(F.col("id").alias("q"), F.col("v").alias("y")), "q").select("q", F.col("v").alias("id"), exact.alias("score"))
        #: k + 1 copies of a node are all that a list of k can need.
        few = self.members.withColumn("i", F.row_number().over(W.partitionBy("id").orderBy("vec_id"))).filter(F.col("i") <= k + 1).drop("i")
        found = asked.join(close, "q").join(few, "id").filter("vec_id <> query_id")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
