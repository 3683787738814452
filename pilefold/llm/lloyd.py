"""Centroid clustering by weighted deduplication: Lloyd's algorithm in integers on the distinct quantised vectors.

Vectors that are equal once quantised take one row with their multiplicity, so a vector that a third of all
rows hold costs one distance a round. A round reads the distinct vectors once; each task adds up its
centroids' components, weighted by multiplicity, and hands on at most k * dim sums; the driver sees k * dim
of them. At the end one join brings clusters back to the vec_ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

LONG = (1 << 63) - 1
#: Largest components for which 64 squared differences are exact in a double, and fit a long.
IN_DOUBLE, IN_LONG = 1 << 22, 1 << 27


def _packed(row: np.ndarray) -> bytes:
    """Integers as the narrowest little-endian ones that hold them all; the first byte is the width. Equal rows give equal bytes."""
    top = max(int(row.max()), -int(row.min()) - 1)
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    got = np.empty((len(column), dim), "i8")
    for i, b in enumerate(column.to_pylist()):
        got[i] = np.frombuffer(b, f"<i{b[0]}", offset=1)
    return got


def quantised(rows: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, q binary) of the rows whose embedding has exactly `dim` components, none null or non-finite; q holds floor(scale * x), x as double, at the ends of a long at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, packed = [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if v is None or len(v) != dim or None in v:
                    continue
                x = np.array(v, "f8")
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    y = np.floor(scale * x)
                wide = np.abs(y) >= 2.0**63
                q = np.where(wide, 0, y).astype("i8")
                q[wide] = np.where(y[wide] > 0, LONG, -LONG)
                ids.append(vec_id)
                packed.append(_packed(q))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "q"])

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, q binary")


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, exact; ties to the smaller number. A distance beyond a long counts as the largest long."""
    top = max(int(np.abs(a).max(initial=0)) for a in (q, centroids))
    if top <= IN_DOUBLE:
        x, c = q.astype("f8"), centroids.astype("f8")
        d = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype("i8")
    elif top <= IN_LONG:
        d = np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)
    else:
        x = q.astype(object)
        d = np.stack([((x - c.astype(object)) ** 2).sum(1) for c in centroids], axis=1)
        at = d.argmin(1)
        return at.astype("i4"), np.array([min(v, LONG) for v in d[np.arange(len(q)), at]], "i8")
    at = d.argmin(1)
    return at.astype("i4"), d[np.arange(len(q)), at]


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Weighted component sums of each cluster, and its count as component -1."""
    k, dim = centroids.shape

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), object)
        for batch in parts:
            q, n = _unpacked(batch.column("q"), dim), batch.column("n").to_numpy(zero_copy_only=False)
            at, _ = nearest(q, centroids)
            for c in np.unique(at):
                here = at == c
                if np.abs(q[here]).max() < IN_LONG and n[here].sum() < 1 << 35:
                    total[c, :dim] += n[here] @ q[here]
                else:
                    total[c, :dim] += n[here].astype(object) @ q[here].astype(object)
                total[c, dim] += int(n[here].sum())
        some = np.nonzero(total[:, dim])[0]
        cells = [(int(c), i if i < dim else -1, Decimal(int(total[c, i]))) for c in some for i in range(dim + 1)]
        columns = zip(*cells) if cells else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.decimal128(38, 0)))], names=["c", "i", "s"])

    got = distinct.mapInArrow(run, "c int, i int, s decimal(38,0)").groupBy("c", "i").agg(F.sum("s").alias("s"))
    return {(r["c"], r["i"]): int(r["s"]) for r in got.collect()}  # k * (dim + 1) rows at most


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1:") -> DataFrame:
    """(vec_id, cluster int, distance, cluster_inertia, inertia long, centroid array<long>, copies long) of every row that quantised() keeps.

    First centroids: the k rows with the smallest lowercase-hex sha256 of seed + vec_id, in that order; rows
    of one vec_id by their components; all rows if they are fewer, and rows without an id start none. Then
    `rounds` times: assign to the nearest, ties to the smaller number, and replace each non-empty centroid by
    the exact floor(sum / count); at last assign once more. Repeated ids are rows of their own; other columns
    don't matter; no row kept gives an empty table. copies: rows with the same quantised vector. Inertia
    beyond a long counts as the largest long.
    """
    spark = rows.sparkSession
    vectors = saved(quantised(rows, dim, scale), "quantised")
    distinct = saved(vectors.groupBy("q").agg(F.count("*").alias("n")), "distinct-vectors")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = vectors.filter("vec_id is not null").select(hashed.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = _unpacked(pa.array([bytes(r["q"]) for r in first], pa.binary()), dim)
    for _ in range(rounds if len(first) else 0):
        sums = _sums(distinct, centroids)
        centroids = np.array([[sums[c, i] // sums[c, -1] for i in range(dim)] if (c, -1) in sums else centroids[c].tolist() for c in range(len(centroids))], "i8")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            at, d = nearest(_unpacked(batch.column("q"), dim), centroids) if len(centroids) else (np.zeros(0, "i4"), np.zeros(0, "i8"))
            kept = batch.slice(0, len(at))
            yield pa.RecordBatch.from_arrays([kept.column("q"), kept.column("n"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["q", "copies", "cluster", "distance"])

    assigned = saved(distinct.mapInArrow(run, "q binary, copies long, cluster int, distance long"), "assigned")
    forget(distinct)
    cost = F.sum(F.col("copies").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)"))
    costs = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(cost.alias("s")).collect()}  # k rows at most
    whole = min(sum(costs.values()), LONG)
    facts = spark.createDataFrame([(c, min(s, LONG), whole, centroids[c].tolist()) for c, s in costs.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    found = vectors.join(assigned, "q").join(F.broadcast(facts), "cluster")  # k rows
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "copies")
