"""Read images of candidate sites.

One row of input is a site with everything it needs: the reference around it and its reads of both samples,
already filtered, deduplicated by name and sampled. Sites are independent, so images are built by
mapInArrow over those rows, some sites at a time (images.py; snv_image and indel_image here state the layout
for one); at most `rows` reads a sample reach a site, which bounds a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Calling, IndelTensor, SnvTensor
from ..functions import cigar as C
from ..functions.encode import DELETE_COLOUR, FORWARD, INSERT_COLOURS, MATCH_COLOURS, MAX_QUALITY, REVERSE, SNV_COLOURS
from .intervals import BIN, with_reference
from .pileup import REVERSED, flagged, is_usable, passes_default
from .rows import dedupe_reads, marked_reads, reaching, sample_replicates

#: Stands for no position in arrays of positions.
NONE = -(1 << 40)


def shade(q: float) -> int:
    return int(255 * (min(MAX_QUALITY, q) / MAX_QUALITY))


def site_rows(candidates: DataFrame, reads: DataFrame, reference: DataFrame, block: int, before: int, after: int, limit: int, seed: int, replicates: int = 1, falling: bool = False, keep: tuple[str, ...] = (), least: int | None = None) -> DataFrame:
    """(chrom, pos, start, ref, normal, tumor, _bin): windows [pos - before, pos + after), clamped at 0, joined with their reads. With replicates, a row for each draw of the reads.

    falling: no draw, but all reads that have one of the first `limit` bases of a column. keep: columns of candidates to have too, the same for all rows of a site.
    least: to have normal_fractions and tumor_fractions too, the shares of A, C, G and T at each place of the window with any, of all reads of the default pileup with at least that quality there.

    A site belongs to the bin of its position and a read goes to each bin that has a site it may reach. First records and ranks are by (chrom, bin) and more, so reads
    are exchanged once, before they are repeated for each site. The choice of reads and the counts for the shares run in Python, after which the reads that are left
    are exchanged by site, to be collected; no image ever is.
    """
    if falling and replicates > 1:
        raise ValueError("bases that fall are not drawn, so there is nothing to repeat")
    c = C.reference_end(F.col("ref_start"), F.col("cigar"))
    use, count = is_usable(F.col("flag")), passes_default(F.col("flag"))
    usable = reads.filter((use if least is None else use | count) & F.col("cigar").isNotNull())
    if "ref_end" not in reads.columns:
        usable = usable.withColumn("ref_end", c)
    more = [] if least is None else [use.alias("_use"), count.alias("_count")]
    sites = candidates.select("chrom", "pos", *keep).dropDuplicates(["chrom", "pos"])
    start = F.greatest(F.col("pos") - before, F.lit(0))
    spans = sites.select("chrom", start.alias("pos"), F.col("pos").alias("site"), (F.col("pos") + after - start).alias("n"), *keep)
    windows = with_reference(spans, reference, F.col("n"), block).select("chrom", "site", F.col("pos").alias("w_start"), (F.col("pos") + F.col("n")).alias("w_end"), "ref", *keep, F.floor(F.col("site") / BIN).alias("_bin"))
    reach = F.sequence(F.floor((F.col("ref_start") - after + 1) / BIN), F.floor((F.col("ref_end") + before - 1) / BIN))
    read = usable.filter("ref_end > ref_start").select("sample", "file_order", "query_name", flagged(F.col("flag"), REVERSED).alias("flag_reverse"), F.col("chrom").alias("_c"), "ref_start", "ref_end", "mapq", "cigar", "seq", F.col("quals").cast("array<smallint>").alias("quals"), *more, F.explode(reach).alias("_b"))
    meets = (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.col("ref_start") < F.col("w_end")) & (F.col("ref_end") > F.col("w_start"))
    met = windows.hint("merge").join(read, meets, "left").drop("_c", "_b")
    place = ["chrom", "_bin", "site"]
    own = [*place, "sample"]
    met = dedupe_reads(met, tuple(own)) if least is None else marked_reads(met, own)
    met = reaching(met, own, limit, least).withColumn("replicate", F.lit(0)) if falling else sample_replicates(met, own, limit, replicates, seed, least)
    shown = F.lit(True) if least is None else F.col("_use")
    read = F.struct("file_order", "flag_reverse", "mapq", "seq", "quals", "ref_start", "ref_end", "cigar")
    of = lambda s: F.sort_array(F.collect_list(F.when((F.col("sample") == s) & shown, read)))
    one = [F.first(k).alias(k) for k in ("w_start", "ref", *keep)]
    if least is not None:
        one += [F.first(F.when(F.col("sample") == s, F.col("_f")), ignorenulls=True).alias(f"_{s}") for s in "NT"]
    grouped = met.groupBy(*place, "replicate").agg(*one, of("N").alias("normal"), of("T").alias("tumor"))
    shares = [] if least is None else [_shares(F.col(f"_{s[0].upper()}"), F.col("w_start")).alias(f"{s}_fractions") for s in ("normal", "tumor")]
    return grouped.select("chrom", F.col("site").alias("pos"), F.col("w_start").alias("start"), "ref", "normal", "tumor", *keep, *shares, "_bin")


def _shares(counts: Column, start: Column) -> Column:
    """Of counts of A, C, G and T, four a place from start on: (at, A, C, G, T), the shares at each place that has any."""
    four = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.size(counts) / 4) - 1), lambda i: F.struct((start + i).alias("at"), F.slice(counts, (i * 4 + 1).cast("int"), 4).alias("n")))
    depth = lambda x: F.aggregate(x["n"], F.lit(0).cast("long"), lambda a, n: a + n)
    share = lambda x: [(F.get(x["n"], F.lit(i)) / depth(x)).cast("float").alias(b) for i, b in enumerate("ACGT")]
    return F.transform(F.filter(four, lambda x: depth(x) > 0), lambda x: F.struct(x["at"], *share(x)))


@lru_cache(maxsize=20_000)
def operations(cigar: str) -> list[tuple[str, int]]:
    return [(op, int(n)) for n, op in re.findall(C.PATTERN, cigar)]


@lru_cache(maxsize=20_000)
def _columns(cigar: str) -> tuple[np.ndarray, np.ndarray]:
    """(read, reference) offsets of the alignment's columns, NONE on a side that has none, without the soft clip of the first and last operation."""
    ops, rp, gp, read, ref = operations(cigar), [], [], 0, 0
    for k, (op, n) in enumerate(ops):
        on_read, on_ref = op in "MIS=X", op in "MDN=X"
        if (on_read or on_ref) and not (op == "S" and k in (0, len(ops) - 1)):
            rp.append(np.arange(read, read + n) if on_read else np.full(n, NONE))
            gp.append(np.arange(ref, ref + n) if on_ref else np.full(n, NONE))
        read, ref = read + n * on_read, ref + n * on_ref
    return (np.concatenate(rp), np.concatenate(gp)) if rp else (np.zeros(0, "i8"), np.zeros(0, "i8"))


class Read:
    """A read's columns, bases and qualities as arrays."""

    def __init__(self, read: dict, missing: int):
        self.rp, gp = _columns(read["cigar"])
        self.gp = np.where(gp == NONE, NONE, gp + read["ref_start"])
        self.bases = np.frombuffer((read["seq"] or "").encode("latin-1", "replace"), "u1")
        self.quals = np.full(len(self.bases), missing, "f8") if read["quals"] is None else np.asarray(read["quals"], "f8")
        self.missing = missing
        self.reverse, self.mapq, self.cigar, self.start = read["flag_reverse"], read["mapq"], read["cigar"], read["ref_start"]

    def quality(self, at: np.ndarray) -> np.ndarray:
        """Qualities at columns; a deleted one has the mean of the nearest base's on either side (the read's first base counts as none)."""
        rp = self.rp[at]
        out = np.full(len(at), float(self.missing))
        out[rp >= 0] = self.quals[rp[rp >= 0]]
        if (rp < 0).any():
            known = np.nonzero((self.rp > 0) & (self.gp != NONE))[0]
            for k in np.nonzero(rp < 0)[0]:
                i = np.searchsorted(known, at[k])
                sides = [self.quals[self.rp[known[x]]] for x in (i - 1, i) if 0 <= x < len(known)]
                if sides:
                    out[k] = sum(sides) / len(sides)
        return out

    def colour(self, at: np.ndarray, colours: np.ndarray) -> np.ndarray:
        rp = self.rp[at]
        out = np.full(len(at), DELETE_COLOUR)
        out[rp >= 0] = colours[self.bases[rp[rp >= 0]]]
        return out


def table(colours: dict[str, int]) -> np.ndarray:
    """Colours by character code, 0 for others."""
    out = np.zeros(256, int)
    for letter, value in colours.items():
        out[ord(letter)] = value
    return out


SNV_TABLE, MATCH_TABLE, INSERT_TABLE = table(SNV_COLOURS), table(MATCH_COLOURS), table(INSERT_COLOURS)


def shades(q: np.ndarray) -> np.ndarray:
    return (255 * (np.minimum(MAX_QUALITY, q) / MAX_QUALITY)).astype(int)


def _paint(image: np.ndarray, row: int, start: int, colours, qualities, read: Read) -> None:
    n = len(colours)
    if n:
        image[row, start : start + n, 0] = colours
        image[row, start : start + n, 1] = shades(np.asarray(qualities, "f8"))
        image[row, start : start + n, 2] = REVERSE if read.reverse else FORWARD
        image[row, start : start + n, 3] = 0 if read.mapq == 255 else shade(read.mapq)


def _fall(image: np.ndarray, free: np.ndarray, start: int, colours, qualities, read: Read) -> None:
    """Each base goes to the next free row of its column; those that find none are left out."""
    columns = np.arange(start, start + len(colours))
    fits = free[columns] < len(image)
    columns = columns[fits]
    line = np.zeros((1, len(colours), 4), "f4")
    _paint(line, 0, 0, colours, qualities, read)
    image[free[columns], columns, :4] = line[0, fits]
    free[columns] += 1


def snv_half(reads, pos: int, cfg: SnvTensor, fractions=None) -> np.ndarray:
    """Rows by 2 * flank + 1 columns by base, quality, strand and mapq. A read without a base in the window still takes a row.

    With allele fractions, the shares of A, T, G and C at a column in all rows: channels 4 to 7.
    """
    low, high = pos - cfg.flank, pos + cfg.flank + 1
    image = np.zeros((cfg.rows, high - low, cfg.shape[2] - 1), "f4")
    free = np.zeros(high - low, int)
    for row, one in enumerate(reads if cfg.falling else reads[: cfg.rows]):
        read = Read(one, cfg.missing_quality)
        at = np.nonzero((read.gp >= low) & (read.gp < high) & (read.gp != NONE))[0]
        if len(at):
            start, colours, qualities = int(read.gp[at[0]]) - low, read.colour(at, SNV_TABLE), read.quality(at)
            if cfg.falling:
                _fall(image, free, start, colours, qualities, read)
            else:
                _paint(image, row, start, colours, qualities, read)
    for x in fractions if fractions is not None and cfg.allele_fractions else ():
        image[:, x["at"] - low, 4:8] = x["A"], x["T"], x["G"], x["C"]
    return image


def snv_image(site, cfg: SnvTensor = SnvTensor()) -> np.ndarray:
    """rows x 2 width x 5 (9 with allele fractions): normal left, tumor right, the site's column repeated, the reference's colours in the last channel of every row."""
    columns = np.repeat(np.arange(2 * cfg.flank + 1), [cfg.repeats if c == cfg.flank else 1 for c in range(2 * cfg.flank + 1)])
    ref = np.zeros(2 * cfg.flank + 1, "f4")
    shown = [SNV_COLOURS.get(b, 0) for b in (site["ref"] or "")][: len(ref)]
    ref[: len(shown)] = shown  # from column 0, also where the window is clamped at the contig's start
    out = np.zeros(cfg.shape, "f4")
    for k, sample in enumerate(("normal", "tumor")):
        reads = site[sample]
        out[:, k * cfg.width : (k + 1) * cfg.width, :-1] = snv_half([] if reads is None else list(reads), site["pos"], cfg, site.get(f"{sample}_fractions"))[:, columns]
        out[:, k * cfg.width : (k + 1) * cfg.width, -1] = ref[columns]
    return out


def insertions(read: Read, low: int, high: int, strict: bool = False) -> dict[int, int]:
    """Longest insertion after each reference position of the window, for one read.

    As in the results to match, every other operation moves the position on, clips too, and only a clip or
    insertion that comes first is passed over; strict=True moves by what the alignment uses of the reference.
    """
    out: dict[int, int] = {}
    last = read.start - 1
    for k, (op, n) in enumerate(operations(read.cigar)):
        if k == 0 and op in "SI":
            continue
        if op == "I":
            if low <= last < high:
                out[last] = max(out.get(last, 0), n)
        elif not strict or op in "MDN=X":
            last += n
    return out


def indel_read(read: Read, low: int, high: int, widest: dict[int, int], trim: int, length: int, strict: bool = False) -> tuple[int, list[float], list[float]]:
    """(start column, colours, qualities) of a read laid out with room for the site's widest insertions; the first `trim` entries go."""
    own = insertions(read, low, high, strict)
    at = np.nonzero((read.gp >= low) & (read.gp < high) & (read.gp != NONE))[0]
    if not len(at):
        return 0, [], []
    start = int(read.gp[at[0]]) - low + sum(n for r, n in widest.items() if r < read.gp[at[0]])
    base, quality = read.colour(at, MATCH_TABLE).tolist(), read.quality(at).tolist()
    colours, qualities = [], []
    for k, b, q in zip(at.tolist(), base, quality):
        colours.append(b)
        qualities.append(q)
        room = widest.get(gp := int(read.gp[k]), 0)
        if room and gp not in own:
            colours += [0] * room
            qualities += [0] * room
        elif room and k + 1 < len(read.gp) and read.gp[k + 1] == NONE:
            put = slice(int(read.rp[k + 1]), int(read.rp[k + 1]) + own[gp])
            put, fill = INSERT_TABLE[read.bases[put]].tolist(), read.quals[put].tolist()
            colours += put + [0] * (room - own[gp])
            qualities += fill + [0] * (room - own[gp])
    room = max(0, length - start)
    return start, colours[trim:][:room], qualities[trim:][:room]


def indel_image(site, cfg: IndelTensor = IndelTensor()) -> np.ndarray:
    """rows x 2 length x 5. A read that is left without entries takes no row; the reference fills as many rows as the fuller sample."""
    low = site["start"]
    high = low + cfg.length
    halves = [[] if site[s] is None else [Read(r, cfg.missing_quality) for r in list(site[s])[: cfg.rows]] for s in ("normal", "tumor")]
    widest: dict[int, int] = {}
    for read in halves[0] + halves[1]:
        for at, n in insertions(read, low, high, cfg.strict_positions).items():
            widest[at] = max(widest.get(at, 0), n)
    before = sum(n for at, n in widest.items() if at < site["pos"])
    after = sum(n for at, n in widest.items() if at >= site["pos"])
    out = np.zeros((cfg.rows, 2 * cfg.length, 5), "f4")
    for k, reads in enumerate(halves):
        row = 0
        for read in reads:
            start, colours, qualities = indel_read(read, low, high, widest, before, cfg.length, cfg.strict_positions)
            if colours:
                _paint(out[:, k * cfg.length : (k + 1) * cfg.length], row, start, colours, qualities, read)
                row += 1
    line: list[float] = []
    for i, base in enumerate(site["ref"] or ""):
        line += [MATCH_COLOURS.get(base, 0)] + [0] * widest.get(low + i, 0)
    line = line[before : len(line) - after]
    if len(line) > cfg.length:
        raise ValueError("the reference row is longer than the image")
    full = max(map(len, halves))
    for k in (0, 1):
        out[:full, k * cfg.length : k * cfg.length + len(line), 4] = line
    return out


#: What is made of some sites' images in the task that paints them: a function from (n, ...) floats to columns, and their names and types.
Then = tuple[Callable[[np.ndarray], list], str]


def tensors(sites: DataFrame, kind: str, cfg=None, then: Then | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chrom, pos, *keep, data array<float>), row-major, of site_rows(); kind is snv or indel. then: its columns instead of the data, so that images don't leave the task."""
    from .images import indel_images, snv_images

    image, cfg = (snv_images, cfg or SnvTensor()) if kind == "snv" else (indel_images, cfg or IndelTensor())
    size = int(np.prod(cfg.shape))
    made, schema = then or (lambda x: [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x.ravel()))], "data array<float>")
    names = ["chrom", "pos", *keep]
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sites.select(*names).schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 16):  # a tensor has 35,000 or 105,000 floats
                some = batch.slice(at, 16)
                out = [x if isinstance(x, pa.Array) else pa.array(x) for x in made(image(some, cfg))]
                yield pa.RecordBatch.from_arrays([*map(some.column, names), *out], names=[*names, *(c.split()[0] for c in schema.split(", "))])

    return sites.mapInArrow(run, types + schema)


def snv_rows(candidates: DataFrame, reads: DataFrame, reference: DataFrame, block: int, cfg: SnvTensor = SnvTensor(), replicates: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    least = Calling().default_base_quality if cfg.allele_fractions else None
    return site_rows(candidates, reads, reference, block, cfg.flank, cfg.flank + 1, cfg.rows, cfg.seed, replicates, cfg.falling, keep, least)


def snv_tensors(candidates: DataFrame, reads: DataFrame, reference: DataFrame, block: int, cfg: SnvTensor = SnvTensor(), replicates: int = 1, then: Then | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return tensors(snv_rows(candidates, reads, reference, block, cfg, replicates, keep), "snv", cfg, then, keep)


def indel_tensors(candidates: DataFrame, reads: DataFrame, reference: DataFrame, block: int, cfg: IndelTensor = IndelTensor(), replicates: int = 1, then: Then | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return tensors(site_rows(candidates, reads, reference, block, cfg.before, cfg.length - cfg.before, cfg.rows, cfg.seed, replicates, keep=keep), "indel", cfg, then, keep)


def allele_fractions(cells: DataFrame) -> DataFrame:
    """(chrom, pos, col, A, T, G, C): each base's share of a column, for the four optional channels. cells: (chrom, pos, col, base)."""
    share = lambda b: F.avg((F.col("base") == b).cast("double")).alias(b)
    return cells.groupBy("chrom", "pos", "col").agg(*[share(b) for b in "ATGC"])


def spiked(sites: DataFrame, base: str | None = None, seed: int = 0) -> DataFrame:
    """Training data: tumor reads with the reference's base at the site get another one, for a variant at a Beta(2, 5) share.

    Of n reads, round(share * n) are to have the variant: in file order the first n less that many with the reference's base
    keep it, all later ones change. Reads with another base or none there stay, so they take of the variant's share. The new base is
    the column `variant` or, without one, `base`; a column `share` goes before the draw.
    """

    from .images import put_in

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 256):
                yield put_in(batch.slice(at, 256), base, seed)

    return sites.mapInArrow(run, sites.schema)


def training_set(tensors: DataFrame, labels: DataFrame) -> DataFrame:
    """Tensors with the labels of their sites; sites without a label are left out."""
    return tensors.join(labels.select("chrom", "pos", "label"), ["chrom", "pos"])
