"""Scalar encodings: colours, distances, ratios, contig names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of bases in SNV tensors.
SNV_COLOURS = {"A": 245, "G": 175, "T": 105, "C": 35, "D": 0, "N": 0}
#: Colours of matched and inserted bases and of deletions in indel tensors.
MATCH_COLOURS = {"A": 250, "G": 220, "T": 190, "C": 160}
INSERT_COLOURS = {"A": 130, "G": 100, "T": 70, "C": 40}
DELETE_COLOUR = 10
MAX_QUALITY = 45
FORWARD, REVERSE = 125, 250


def _mapped(base: Column, colours: dict[str, int]) -> Column:
    out = F.lit(0)
    for letter, value in colours.items():
        out = F.when(base == letter, F.lit(value)).otherwise(out)
    return out


def snv_colour(base: Column) -> Column:
    return _mapped(base, SNV_COLOURS)


def match_colour(base: Column) -> Column:
    return _mapped(base, MATCH_COLOURS)


def insert_colour(base: Column) -> Column:
    return _mapped(base, INSERT_COLOURS)


def quality_colour(q: Column) -> Column:
    return (F.lit(255.0) * (F.least(F.lit(float(MAX_QUALITY)), q.cast("double")) / F.lit(float(MAX_QUALITY)))).cast("int")


def mapq_colour(q: Column) -> Column:
    return F.when(q == 255, F.lit(0)).otherwise(quality_colour(q))


def strand_colour(reverse: Column) -> Column:
    return F.when(reverse, F.lit(REVERSE)).otherwise(F.lit(FORWARD))


def match_value(op: Column, base: Column) -> Column:
    return F.when(op == "D", F.lit(DELETE_COLOUR)).otherwise(snv_colour(base))


def end_distance(to_start: Column, to_end: Column) -> Column:
    """The smaller of two distances, a zero counting as missing; null if both are."""
    return F.least(F.nullif(to_start, F.lit(0)), F.nullif(to_end, F.lit(0)))


def with_chr(chrom: Column) -> Column:
    return F.when(chrom == "MT", F.lit("chrM")).otherwise(F.concat(F.lit("chr"), chrom))


def without_chr(chrom: Column) -> Column:
    """chrM and M are MT; other names lose a leading chr."""
    return F.when(chrom.isin("chrM", "M"), F.lit("MT")).otherwise(F.regexp_replace(chrom, "^chr", ""))


def ten_thousandths(x: Column) -> Column:
    """A double >= 0 in ten-thousandths (long), rounded by its exact binary value, half to even: what Python's round(x, 4) has.

    x lies between k and k + 1 ten-thousandths; it is compared with the middle, (2k + 1) / 20,000, without
    an error: x is split into a high and a low half of 26 bits, whose products with 20,000 are exact.
    """
    x = x.cast("double")
    k = F.floor(x * 10000.0)
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    over = (high * 20000.0 - (2 * k + 1).cast("double")) + (x - high) * 20000.0
    return F.when(over > 0, k + 1).when(over < 0, k).otherwise(k + k % 2)


def round4(x: Column) -> Column:
    return ten_thousandths(x) / F.lit(10000.0)


def ratio4(a: Column, b: Column) -> Column:
    """a / b to four places, as round4 has it; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(round4(a.cast("double") / b.cast("double")))


def binary_entropy(p: Column) -> Column:
    """Bits of a yes/no event; null outside (0, 1)."""
    return F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def number_text(x: Column) -> Column:
    """A number >= 0 to four places as text, without trailing zeros but with one digit after the point."""
    n = ten_thousandths(x)
    digits = F.lpad((n % 10000).cast("string"), 4, "0")
    return F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.regexp_replace(digits, r"(?<=\d)0+$", ""))


def site_key(chrom: Column, pos: Column) -> Column:
    """A site as one string; joins use the two columns."""
    return F.concat(F.lit("chrom"), chrom, F.lit("pos"), pos.cast("string"))


def clip_proximity(clip_end: Column, clip_start: Column, at: Column, length: Column, default: Column) -> Column:
    """Distance of an indel to the nearer of the clips around it; a clip at zero counts as missing, without any the default."""
    after = F.nullif(clip_end, F.lit(0)) - at - length
    before = at - F.nullif(clip_start, F.lit(0))
    return F.coalesce(F.least(after, before), default)


def prefix_repeat(seq: Column) -> Column:
    """struct<size, repeats>: the last prefix of seq that what follows it repeats, at least by one letter, and how often it stands there; (1, 1.0) if none does.

    A prefix is taken as the unit; at the first letter that breaks the repetition, everything up to and with that letter is the next unit. Counted for a batch at a time; null counts as empty.
    """

    @F.pandas_udf("size int, repeats double")
    def found(seqs: pd.Series) -> pd.DataFrame:
        size, repeats = _prefix_repeats(seqs.fillna("").tolist())
        return pd.DataFrame({"size": size, "repeats": repeats})

    return found(seq)


def _prefix_repeats(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All of them a letter at a time, the longest first, so that a step touches those that still have a letter (or just ended)."""
    length = np.fromiter(map(len, seqs), "i8", len(seqs))
    order = np.argsort(-length, kind="stable")
    length = length[order]
    start = np.cumsum(length) - length
    letters = np.frombuffer("".join([seqs[i] for i in order]).encode("utf-32-le"), "u4")
    unit, run, size, repeats = np.ones(len(seqs), "i8"), np.zeros(len(seqs), "i8"), np.ones(len(seqs), "i4"), np.ones(len(seqs))
    for at in range(1, int(length.max(initial=0)) + 1):
        n = np.searchsorted(-length, -at, "right")  # the first n have at letters at least
        more = np.searchsorted(-length, -at - 1, "right")
        goes_on = np.zeros(n, bool)
        goes_on[:more] = letters[start[:more] + at] == letters[start[:more] + run[:more] % unit[:more]]
        ends = np.nonzero(~goes_on & (run[:n] > 0))[0]
        size[ends], repeats[ends] = unit[ends], run[ends] / unit[ends] + 1
        unit[:n], run[:n] = np.where(goes_on, unit[:n], at + 1), np.where(goes_on, run[:n] + 1, 0)
    back = np.argsort(order)
    return size[back], repeats[back]


def tandem_repeat(left: Column, right: Column) -> Column:
    """struct<size, repeats> of the tandem repeat at a site, from the bases before it (read backwards) and from it on: the side with the longer unit, both together if they are equal."""
    a, b = prefix_repeat(F.reverse(left)), prefix_repeat(right)
    both = F.struct(b["size"].alias("size"), (a["repeats"] + b["repeats"]).alias("repeats"))
    return F.when(b["size"] > a["size"], b).when(a["size"] > b["size"], a).otherwise(both)
