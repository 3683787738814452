"""Random-projection tree forest and near-dedup of embeddings with it.

A tree splits the vectors again and again by their projection on a random direction, at the median; with
spill overlap a vector near the cut goes both ways. The upper part of each tree is fitted on one bounded
sample (`sample` rows by hash) and sent to every task. Leaves that are still large go on splitting where
they are: each draws a bounded sample of its own, fits a subtree, and routes its rows through it in groups
of bounded size; so leaves stay of one size however many vectors there are, and no task or driver holds
more than a sample and a group. Vectors that meet in a leaf are compared, in double precision on the
original values, so a reported pair is always right and only recall depends on the forest.

Vectors of different lengths have no cosine or distance; each length has its own trees and leaves.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import forget, sampled, saved

#: A leaf is named by its tree (the bits from 56 on) and a hash of its length and of the path to it.
TREE = 56
_MASK, _U = np.uint64((1 << TREE) - 1), np.uint64
#: Rows of a large leaf that its subtree is fitted on, and that are routed through it in one group, about.
FITTED, ROUTED = 1024, 20_000


def usable(df: DataFrame) -> DataFrame:
    """Rows (vec_id, v array<double>) that take part: id and vector not null, no null or non-finite component, not zero."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return df.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & some)


def grow(x: np.ndarray, rows: int, trees: int, leaf: int, seed: int, spill: float = 0.0) -> list[list]:
    """Trees over the sample x that cut `rows` rows, in proportion, into leaves of about `leaf`: nested [direction, cut, left, right] or a leaf's number.

    A node most of whose rows lie within the spill of the cut stays whole: both sides would have them all.
    """
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        count = [0]

        def ended() -> int:
            count[0] += 1
            return count[0] - 1

        def split(ids: np.ndarray):
            if rows * len(ids) <= leaf * len(x) or len(ids) < 8:
                return ended()
            direction = x[rng.choice(ids)] - x[rng.choice(ids)] + rng.normal(0, 1e-3, x.shape[1])
            direction /= np.linalg.norm(direction)
            p = x[ids] @ direction
            cut = float(np.median(p))
            if spill and (np.abs(p - cut) <= spill).mean() > 0.8:
                return ended()
            low = p <= cut
            if low.all() or not low.any():
                low = np.arange(len(ids)) * 2 < len(ids)
            return [direction, cut, split(ids[low]), split(ids[~low])]

        out.append(split(np.arange(len(x))))
    return out


def count_leaves(node) -> int:
    return count_leaves(node[2]) + count_leaves(node[3]) if isinstance(node, list) else 1


def route(x: np.ndarray, trees: list, spill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, leaf number) for each leaf that a row of x reaches."""
    rows, numbers, leaves = [], [], []
    for t, tree in enumerate(trees):
        todo = [(tree, np.arange(len(x)))]
        while todo:
            node, ids = todo.pop()
            if not len(ids):
                continue
            if not isinstance(node, list):
                rows.append(ids)
                numbers.append(np.full(len(ids), t))
                leaves.append(np.full(len(ids), node))
                continue
            p = x[ids] @ node[0]
            todo += [(node[2], ids[p <= node[1] + spill]), (node[3], ids[p > node[1] - spill])]
    return tuple(np.concatenate(c) if c else np.zeros(0, "i8") for c in (rows, numbers, leaves))


def named(tree, parent, number) -> np.ndarray:
    """Names of leaves: the tree and a hash of the parent's name (at the top, the vectors' length) and the leaf's number under it."""
    h = (np.asarray(parent).astype("u8") * _U(0x9E3779B97F4A7C15)) ^ (np.asarray(number).astype("u8") + _U(0x632BE59BD9B4E019))
    for turn, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> _U(turn))) * _U(by)
    return ((np.asarray(tree).astype("u8") << _U(TREE)) | ((h ^ (h >> _U(31))) & _MASK)).astype("i8")


def reached(vectors, forest: dict[int, list], spill: float, prepare) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf's name) for each leaf that the vectors of a batch reach, each in the trees of its length."""
    sizes = np.fromiter((len(v) for v in vectors), int, len(vectors))
    rows, names = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        row, tree, number = route(prepare(stacked(vectors.iloc[at])), forest[int(d)], spill)
        rows.append(at[row])
        names.append(named(tree, int(d), number))
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return row[order], name[order]


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("f8", copy=False) if len(column) else np.zeros((0, 1))


def plant(vectors: DataFrame, trees: int, leaf: int, seed: int, sample: int, prepare, spill: float = 0.0) -> tuple[dict[int, list], dict[int, int]]:
    """(trees of each length, rows of each length), from about `sample` vectors (all, if no more), taken by a hash of their id (vec_id). A length that the sample lacks is one leaf a tree."""
    rows = {r["d"]: r["count"] for r in vectors.groupBy(F.size("v").alias("d")).count().collect()}  # one row a length

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": [np.asarray(v, "f8").tobytes() for v in pdf["v"]]})

    # As bytes: the driver would hold a Python object for each component.
    got = sampled(vectors.select("vec_id", "v"), sample, seed, "vec_id").mapInPandas(packed, "vec_id long, v binary").toPandas().sort_values("vec_id")
    size = got["v"].map(len) // 8 if len(got) else got["v"]
    out = {}
    for d, n in rows.items():
        x = got["v"][size == d]
        out[d] = grow(prepare(np.frombuffer(b"".join(x), "f8").reshape(len(x), d)), n, trees, leaf, seed, spill) if len(x) else [0] * trees
    return out, rows


def large(placed: DataFrame, most: int) -> DataFrame:
    """(leaf, n) of the leaves with more than `most` rows. placed: (id, leaf, done)."""
    return placed.filter("not done").groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > most)


def split_large(placed: DataFrame, vectors: DataFrame, most: int, leaf: int, spill: float, seed: int, prepare, rounds: int = 12) -> DataFrame:
    """placed (id, leaf, done) with every leaf of more than `most` rows split further, until none is left or no split helps. vectors: (id, v), one length a leaf.

    A round: each large leaf fits a subtree on a bounded sample of its rows; the rows, salted into groups of
    bounded size, each with the subtree beside it, are routed through it. A leaf that its subtree keeps whole
    (all its rows lie within the spill of any cut) is done.
    """

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        name, n = int(pdf["leaf"].iloc[0]), int(pdf["n"].iloc[0])
        tree = grow(prepare(stacked(pdf["v"])), n, 1, leaf, (seed + name) & 0x7FFFFFFF, spill)[0]
        return pd.DataFrame({"leaf": [name], "tree": [pickle.dumps(tree)]})

    def routed(pdf: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"id": [], "leaf": [], "done": []})
        name = int(pdf["leaf"].iloc[0])
        tree = pickle.loads(trees["tree"].iloc[0]) if len(trees) else 0
        row, _, number = route(prepare(stacked(pdf["v"])), [tree], spill)
        names = named(np.full(len(row), name >> TREE), name & int(_MASK), number)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[row], "leaf": names, "done": not isinstance(tree, list)})

    for _ in range(rounds):
        big = saved(large(placed, most), "large")
        if not big.count():
            return placed
        salts = F.ceil(F.col("n") / ROUTED).cast("int")
        members = saved(placed.filter("not done").join(big, "leaf").join(vectors, "id").select("id", "leaf", "n", "v"), "members")
        share = F.pmod(F.xxhash64(F.lit(seed), "id", "leaf"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        trees = members.filter(share < F.lit(float(FITTED)) / F.col("n")).groupBy("leaf").applyInPandas(fitted, "leaf long, tree binary")
        trees = big.join(trees, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
        moved = salted.groupBy("leaf", "salt").cogroup(trees.groupBy("leaf", "salt")).applyInPandas(routed, "id long, leaf long, done boolean")
        placed = saved(placed.join(big, "leaf", "left_anti").select("id", "leaf", "done").unionByName(moved), "placed")
        forget(members)
    return placed


def _pairs(x: np.ndarray, y: np.ndarray | None, least: float, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a dot product of at least `least`, by blocks; without y, each pair of x once."""
    other = x if y is None else y
    for a in range(0, len(x), block):
        for b in range(a if y is None else 0, len(other), block):
            i, j = np.nonzero(x[a : a + block] @ other[b : b + block].T >= least)
            i, j = i + a, j + b
            if y is None:
                i, j = i[i < j], j[i < j]
            yield i, j


class _Met:
    """Which leaves the rows of a group reach, tree by tree: trees x rows x most leaves in a tree, padded."""

    def __init__(self, lists):
        size = np.array([len(x) for x in lists])
        every, row = np.concatenate(list(lists)), np.repeat(np.arange(len(size)), size)
        tree = every >> TREE
        new = np.nonzero((np.diff(row, prepend=-1) != 0) | (np.diff(tree, prepend=-1) != 0))[0]
        at = np.arange(len(every)) - np.repeat(new, np.diff(np.append(new, len(every))))
        self.left = np.full((int(tree.max()) + 1, len(size), int(at.max()) + 1), -1, "i8")
        self.left[tree, row, at] = every
        self.right = np.where(self.left < 0, -2, self.left)

    def first(self, p: np.ndarray, q: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that meet in no smaller leaf than this one. Near pairs mostly meet in an earlier tree, so few go through all."""
        for tree in range((leaf >> TREE) + 1):
            if not len(p):
                break
            a, b = self.left[tree][p], self.right[tree][q]
            hit = (a[:, :, None] == b[:, None, :]).any(axis=2)
            if tree == leaf >> TREE:
                keep = np.where(hit, a, np.iinfo("i8").max).min(axis=1) == leaf
            else:
                keep = ~hit.any(axis=1)
            p, q = p[keep], q[keep]
        return p, q


def near_duplicates(embeddings: DataFrame, least: float = 0.9, trees: int = 12, leaf: int = 400, spill: float = 0.02, sample: int = 16384, cell: int = 2000, most: int = 16_000, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with cosine >= `least` that share a leaf.

    Equal vectors are one node with a multiplicity, so copies are never expanded. Leaves with more than
    `most` nodes are split further (split_large); one with more than `cell` is dealt out as pairs of blocks, each a task's group of at most about two blocks, so a
    dense group grows over tasks, not in one. A pair that meets in several leaves counts in the smallest
    leaf id that both reach. A group sends back one count and one edge (to the smallest id it is linked
    with there) a node, never its pairs. Rows that take no part (null, empty, zero, null or non-finite
    components) come back with no link and themselves as component; so do vectors of which no other has the
    length. A null vec_id has a null component and is kept. Rows that repeat a vec_id each come back with
    the id's links. Other columns are not read; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    fine = usable(embeddings)
    nodes = saved(fine.groupBy("v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("m")).select("id", "m", "v"), "nodes")
    planted, _ = plant(nodes.select(F.col("id").alias("vec_id"), "v"), trees, leaf, seed, sample, unit, spill)
    forest = spark.sparkContext.broadcast(planted)  # trees * sample / 4 directions at most

    def routed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                row, name = reached(pdf["v"], forest.value, spill, unit)
                yield pdf[["id", "m", "v"]].assign(leaves=np.split(name, np.searchsorted(row, np.arange(1, len(pdf)))))

    placed = saved(nodes.mapInPandas(routed, "id long, m long, v array<double>, leaves array<long>"), "placed")
    coarse = placed.select("id", F.explode("leaves").alias("leaf"), F.lit(False).alias("done"))
    if large(coarse, most).limit(1).count():
        fine_leaves = split_large(coarse, nodes.select("id", "v"), most, leaf, spill, seed, unit)
        lists = fine_leaves.groupBy("id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
        old, placed = placed, saved(nodes.join(lists, "id").select("id", "m", "v", "leaves"), "placed")
        forget(old)
    # One row a leaf, in proportion to the nodes; broadcast only if its size allows.
    full = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / cell).cast("int").alias("g"))
    block = F.pmod(F.xxhash64("id"), F.col("g")).cast("int")
    dealt = (
        placed.select("id", "m", F.col("v").cast("array<float>").alias("v") if is_float(embeddings) else "v", "leaves", F.explode("leaves").alias("leaf"))
        .join(full, "leaf")
        .withColumn("mine", block)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("id", "m", "v", "leaves", "leaf", "mine", F.least("mine", "with").alias("lo"), F.greatest("mine", "with").alias("hi"))
    )

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf_id, lo, hi = (int(pdf[c].iloc[0]) for c in ("leaf", "lo", "hi"))
        pdf = pdf.sort_values("id", ignore_index=True)
        x, ids, m = unit(stacked(pdf["v"])), pdf["id"].to_numpy(), pdf["m"].to_numpy()
        a, b = np.nonzero(pdf["mine"].to_numpy() == lo)[0], np.nonzero(pdf["mine"].to_numpy() == hi)[0]
        met = _Met(pdf["leaves"])
        links, root = np.zeros(len(x), "i8"), np.arange(len(x))
        found = []
        for i, j in _pairs(x[a], None if lo == hi else x[b], least):
            i, j = a[i], b[j]
            for at in range(0, len(i), 20_000):
                p, q = i[at : at + 20_000], j[at : at + 20_000]
                p, q = met.first(p, q, leaf_id)
                np.add.at(links, p, m[q])
                np.add.at(links, q, m[p])
                if len(p):
                    found.append((p, q))
        if found:
            p, q = (np.concatenate(x) for x in zip(*found))
            while True:  # smallest position over links inside this group
                new = root.copy()
                np.minimum.at(new, p, root[q])
                np.minimum.at(new, q, root[p])
                new = new[new]
                if (new == root).all():
                    break
                root = new
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})

    met = saved(dealt.groupBy("leaf", "lo", "hi").applyInPandas(compared, "id long, links long, root long"), "met")
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    whole = (
        fine.select("vec_id", "v").join(nodes.select("id", "m", F.col("v")), "v").drop("v")
        .join(counts, "id", "left")
        .join(comp.withColumnRenamed("node", "id"), "id", "left")
        .groupBy("vec_id")  # a repeated id may stand on several vectors
        .agg(F.max(F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.min(F.coalesce("component", "id")).alias("component_id"))
    )
    out = embeddings.select("vec_id").join(whole, "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def is_float(df: DataFrame) -> bool:
    return df.schema["embedding"].dataType.simpleString() == "array<float>"
