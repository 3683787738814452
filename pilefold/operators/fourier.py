"""Fourier power of base indicators in sliding windows over a reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BASES
from .sweep import _flat

#: Letters of texts that are looked at together, about.
LETTERS_HELD = 100_000


def powers(seq: str, n: int, k: int) -> np.ndarray:
    """For each window of n letters, the power at frequency k of n: the squared size of the k-th Fourier coefficient of each base's 0/1 indicator, added up over A, C, G, T.

    The turned indicators are summed once along the text; a window is the difference of two sums, and where it
    begins only turns its coefficient, which leaves the size as it is.
    """
    letters = np.frombuffer(seq.upper().encode("ascii", "replace"), "u1")
    if len(letters) < n:
        return np.zeros(0)
    turn = np.exp(-2j * np.pi * k / n * (np.arange(len(letters)) % n))
    out = np.zeros(len(letters) - n + 1)
    for b in BASES:
        run = np.concatenate([[0], np.cumsum(np.where(letters == ord(b), turn, 0))])
        out += np.abs(run[n:] - run[:-n]) ** 2
    return out


def fourier_power(reference: DataFrame, block: int, n: int = 12, k: int = 4) -> DataFrame:
    """(chrom, pos, power) for each window [pos, pos + n) of a reference in blocks of `block` bases (n - 1 at least): k = n / 3 is the period of three. Windows run into the next block; none goes over a gap. Other letters than A, C, G, T add nothing."""
    if block < n - 1:
        raise ValueError("a window must not reach over more than two blocks")
    after = reference.select("chrom", (F.col("block_start") - block).alias("block_start"), F.substring("seq", 1, n - 1).alias("more"))
    both = reference.join(after, ["chrom", "block_start"], "left").select("chrom", "block_start", F.concat(F.col("seq"), F.when(F.length("seq") == block, F.coalesce("more", F.lit(""))).otherwise("")).alias("seq"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column("seq").fill_null("").to_pylist()
            sizes = np.array([len(t) for t in texts], "i8")
            many = np.maximum(sizes - n + 1, 0)
            for some in np.split(np.arange(len(texts)), np.nonzero(np.diff(np.cumsum(sizes) // LETTERS_HELD))[0] + 1):
                got = powers("".join(texts[i] for i in some), n, k)  # over the borders of texts too; those windows go
                which = _flat((np.cumsum(sizes[some]) - sizes[some]), many[some])
                start = batch.column("block_start").to_numpy(zero_copy_only=False)[some]
                chrom = batch.column("chrom").take(pa.array(np.repeat(some, many[some])))
                yield pa.RecordBatch.from_arrays([chrom, pa.array(_flat(start, many[some])), pa.array(got[which])], names=["chrom", "pos", "power"])

    return both.mapInArrow(run, "chrom string, pos long, power double")
