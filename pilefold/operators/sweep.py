"""Base counts by a sweep over Arrow batches of reads, without a row for each base.

A batch's aligned bases are laid out as flat arrays (the CIGARs of a batch are few texts, each parsed once);
counting them by position leaves one row a position, sample and batch. Batches of reads in order of position
cover a depth many times over, so what is exchanged is some rows a position, not one for each base.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BASES
from ..functions.cigar import PATTERN
from .intervals import BIN

#: Aligned bases that are laid out at a time, about; a single longer read is laid out whole.
BASES_HELD = 2_000_000
#: 0 to 3 for A, C, G, T of either case, 4 for any other letter.
CODE = np.full(256, 4, "i8")
for _i, _b in enumerate(BASES):
    CODE[[ord(_b), ord(_b.lower())]] = _i
OUT = "sample string, chrom string, pos long, a long, c long, g long, t long"


def segments(cigar: str) -> np.ndarray:
    """(reference offset, read offset, length) of each M, = and X operation."""
    out, ref, read = [], 0, 0
    for n, op in re.findall(PATTERN, cigar):
        if op in "M=X":
            out.append((ref, read, int(n)))
        ref += int(n) * (op in "M=XDN")
        read += int(n) * (op in "M=XIS")
    return np.array(out, "i8").reshape(-1, 3)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (and the last ends); a null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "i8", len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], "u1") if column.buffers()[2] is not None else np.zeros(0, "u1")
    return data, offsets


def _flat_quals(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of all lists, where each begins, and which lists are there."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(column.buffers()[1], "i4", len(column) + 1, column.offset * 4).astype("i8")
    return values, offsets, column.is_valid().to_numpy(zero_copy_only=False)


def count_batch(batch: pa.RecordBatch, cigars: dict[str, np.ndarray], least: int, default: int = 255) -> Iterator[pa.RecordBatch]:
    """Rows of OUT for a batch of (sample, chrom, ref_start, cigar, seq, quals[, _bin]); a base without a quality has `default`."""
    texts = batch.column("cigar").dictionary_encode()
    of = [cigars.setdefault(c, segments(c)) for c in texts.dictionary.to_pylist()]
    code = texts.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    seq, seq_at = _flat_bytes(batch.column("seq"))
    quals, quals_at, has = _flat_quals(batch.column("quals"))
    sizes_q = np.diff(quals_at)
    lengths = np.array([s[:, 2].sum() for s in of] + [0], "i8")[code]
    samples, chroms = batch.column("sample").dictionary_encode(), batch.column("chrom").dictionary_encode()
    pair = samples.indices.fill_null(0).to_numpy(zero_copy_only=False).astype("i8") * max(len(chroms.dictionary), 1) + chroms.indices.fill_null(0).to_numpy(zero_copy_only=False)
    start = _column(batch, "ref_start")
    bins = _column(batch, "_bin") if "_bin" in batch.schema.names else None
    usable = (lengths > 0) & chroms.is_valid().to_numpy(zero_copy_only=False)
    for p in np.unique(pair[usable]):
        rows = np.nonzero(usable & (pair == p))[0]
        cut = np.cumsum(lengths[rows]) // BASES_HELD
        for held in np.split(rows, np.nonzero(np.diff(cut))[0] + 1):
            n_seg = np.array([len(s) for s in of], "i8")[code[held]]
            seg = np.concatenate([of[c] for c in code[held]])
            read = np.repeat(held, n_seg)
            pos = _flat(start[read].astype("i8") + seg[:, 0], seg[:, 2])
            at, read = _flat(seg[:, 1], seg[:, 2]), np.repeat(read, seg[:, 2])
            keep = at < (seq_at[read + 1] - seq_at[read])
            if bins is not None:
                keep &= pos // BIN == bins[read]
            pos, at, read = pos[keep], at[keep], read[keep]
            known = has[read] & (at < sizes_q[read])
            q = np.full(len(read), default, "i8")
            q[known] = quals[(quals_at[read] + at)[known]]
            good = q >= least
            pos, base = pos[good], CODE[seq[(seq_at[read] + at)[good]]]
            if not len(pos):
                continue
            low = int(pos.min())
            if int(pos.max()) - low < 4 * len(pos) + 1_000_000:  # reads in order lie close together
                got = np.bincount((pos - low) * 5 + base, minlength=5).astype("i8")
                got = np.pad(got, (0, -len(got) % 5)).reshape(-1, 5)
                here = np.nonzero(got.any(axis=1))[0]
                where, got = here + low, got[here]
            else:
                where, inverse = np.unique(pos, return_inverse=True)
                got = np.bincount(inverse * 5 + base, minlength=5 * len(where)).astype("i8").reshape(-1, 5)
            sample, chrom = samples.dictionary[int(p) // max(len(chroms.dictionary), 1)], chroms.dictionary[int(p) % len(chroms.dictionary)]
            n = len(where)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sample.as_py()] * n, pa.string()), pa.array([chrom.as_py()] * n, pa.string()), pa.array(where), *(pa.array(np.ascontiguousarray(got[:, i])) for i in range(4))],
                names=["sample", "chrom", "pos", "a", "c", "g", "t"],
            )


def partial_counts(reads: DataFrame, least: int, keep: int = 50_000) -> DataFrame:
    """(sample, chrom, pos, a, c, g, t): some rows a position, to be added up. reads: filtered as wanted; with `_bin`, as near() gives them, only bases of their bin count."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cigars: dict[str, np.ndarray] = {}
        for batch in parts:
            if len(cigars) > keep:
                cigars.clear()
            if batch.num_rows:
                yield from count_batch(batch, cigars, least)

    columns = ["sample", "chrom", "ref_start", "cigar", "seq", "quals", *(["_bin"] if "_bin" in reads.columns else [])]
    return reads.select(*columns).withColumn("quals", F.col("quals").cast("array<smallint>")).mapInArrow(run, OUT)


def window_counts(least: int, default: int = 255):
    """A function of the columns (last, counts, w_start, w_end, ref_start, cigar, seq, quals) of reads that come window by window: on the last
    one of each window, the numbers of A, C, G and T at its places, four a place, over the reads that count; null on the others.

    Only what a read has inside its window is laid out, and no more than a window's numbers is kept from batch to batch.
    """

    @F.arrow_udf("array<int>")
    def counted(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held = np.zeros(0, "i8")
        for last, counts, low, high, start, cigar, seq, quals in parts:
            last, counts = (x.fill_null(False).to_numpy(zero_copy_only=False) for x in (last, counts))
            low, high, start = (x.fill_null(0).to_numpy(zero_copy_only=False).astype("i8") for x in (low, high, start))
            texts = cigar.dictionary_encode()
            of = [segments(c) for c in texts.dictionary.to_pylist()]
            n_seg = np.array([*map(len, of), 0], "i8")[texts.indices.fill_null(len(of)).to_numpy(zero_copy_only=False)]
            n_seg = np.where(counts, n_seg, 0)
            rows = np.nonzero(n_seg)[0]
            seg = np.concatenate([np.zeros((0, 3), "i8"), *(of[c] for c in texts.indices.take(pa.array(rows)).to_pylist())])
            row = np.repeat(rows, n_seg[rows])
            begin = start[row] + seg[:, 0]
            first = np.maximum(begin, low[row])
            size = np.maximum(np.minimum(begin + seg[:, 2], high[row]) - first, 0)
            at, place, row = _flat(seg[:, 1] + first - begin, size), _flat(first - low[row], size), np.repeat(row, size)
            data, seq_at = _flat_bytes(seq)
            there = at < np.diff(seq_at)[row]
            at, place, row = at[there], place[there], row[there]
            values, quals_at, has = _flat_quals(quals)
            known = has[row] & (at < np.diff(quals_at)[row])
            q = np.full(len(row), default, "i8")
            q[known] = values[(quals_at[row] + at)[known]]
            base = CODE[data[seq_at[row] + at]] if len(row) else at
            good = (q >= least) & (base < len(BASES))
            width, window = high - low, np.cumsum(last) - last
            most, n = int(width.max(initial=0)), int(window.max(initial=-1)) + 1
            got = np.bincount((window[row[good]] * most + place[good]) * len(BASES) + base[good], minlength=n * most * len(BASES)).reshape(n, most * len(BASES))
            if n:
                got[0, : len(held)] += held
                held = np.zeros(0, "i8") if last[-1] else got[-1, : width[-1] * len(BASES)]
            out = got[: int(last.sum())]
            out = out[np.arange(out.shape[1]) < (width[last] * len(BASES))[:, None]]
            ends = np.cumsum(np.where(last, width * len(BASES), 0))
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(out, pa.int32()), mask=pa.array(~last))

    return counted.asNondeterministic()  # what it gives follows from the order of rows


def in_place(reads: DataFrame) -> DataFrame:
    """Reads brought together by where they begin, each once, and put in order there, so that those of a batch lie over each other."""
    return reads.repartition("chrom", F.floor(F.col("ref_start") / BIN)).sortWithinPartitions("chrom", "ref_start")


def coverage_sweep(reads: DataFrame, min_base_quality: int = 22, in_order: bool = False) -> DataFrame:
    """(sample, chrom, pos, a, c, g, t, depth) of every position that an aligned base of the quality covers; letters other than A, C, G and T cover it and count for none. in_order: as sweep() has it."""
    out = partial_counts(_held(reads, in_order), min_base_quality).groupBy("sample", "chrom", "pos").agg(*[F.sum(b.lower()).alias(b.lower()) for b in BASES])
    return out.withColumn("depth", F.col("a") + F.col("c") + F.col("g") + F.col("t"))


def _held(reads: DataFrame, in_order: bool) -> DataFrame:
    few = [c for c in ("sample", "chrom", "ref_start", "cigar", "seq", "quals", "_bin") if c in reads.columns]
    return reads if in_order else in_place(reads.select(*few).withColumn("quals", F.col("quals").cast("array<smallint>")))


def sweep(reads: DataFrame, min_base_quality: int = 22, sites: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """(chrom, pos, n, t): count arrays of normal and tumor; with sites (chrom, pos), those only, taken before anything is exchanged for the sum.

    in_order: reads come in order of position, as files and the read store have them. Others are put in order first: a batch of reads from anywhere
    would leave a row for nearly each base. An exchange of reads is some bytes a base less than that.
    """
    some = partial_counts(_held(reads, in_order), min_base_quality)
    if sites is not None:
        some = some.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    of = lambda s: F.array(*[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col(b.lower()))), F.lit(0).cast("long")) for b in BASES])
    return some.groupBy("chrom", "pos").agg(of("N").alias("n"), of("T").alias("t"))
