"""BAM as a Python data source: spark.dataSource.register(BamSource); spark.read.format("bam").option("sample", "N").load(path).

A reader plans with the index (.bai or .csi): the bins that a region overlaps give chunks of the file, the
chunks of all regions are merged, and a partition takes about `splitBytes` of them. Tasks inflate their
chunks, find where records begin and decode all fields of a batch at once into Arrow columns.
"""

from __future__ import annotations

import glob
import gzip
import json
import os
import struct
import warnings
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, InputPartition, LessThan
from pyspark.sql.types import StructType

from ..schema import READS

#: Fixed values of the format: codes of bases and operations.
SEQ, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Operations that use up reference positions.
ON_REFERENCE = np.array([o in "MDN=X" for o in OPS] + [False] * 7)
#: The two letters of each byte of packed bases.
LETTERS = np.frombuffer("".join(a + b for a in SEQ for b in SEQ).encode(), "u1").reshape(256, 2)
#: Bytes of inflated data that are decoded at a time, about.
BATCH = 8 << 20
#: A position past the end of any contig.
FAR = 1 << 40

Range = tuple[int, "int | None"]


def open_file(path: str):
    """A seekable binary file: a local one, or by pyarrow's file systems where the path has a scheme (s3, gs, hdfs, file)."""
    if "://" in path:
        from pyarrow.fs import FileSystem

        system, inner = FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _exists(path: str) -> bool:
    if "://" in path:
        from pyarrow.fs import FileSystem, FileType

        system, inner = FileSystem.from_uri(path)
        return system.get_file_info(inner).type == FileType.File
    return os.path.exists(path)


def blocks(file, start: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place in the file, inflated bytes) of the BGZF blocks from place `start` on; with `stop`, up to the block that begins there or later, which is left out."""
    file.seek(start)
    at = start
    while stop is None or at < stop:
        head = file.read(18)
        if len(head) < 18:
            return
        size = struct.unpack_from("<H", head, 16)[0] + 1
        yield at, zlib.decompress(file.read(size - 18)[:-8], -15)
        at += size


def header(path: str) -> tuple[list[tuple[str, int]], int]:
    """Contigs (name, length) and the virtual offset of the first record."""
    with open_file(path) as file:
        data, parts = b"", []
        for place, block in blocks(file, 0):
            parts.append((len(data), place))
            data += block
            if data[:4] != b"BAM\1":
                raise ValueError(f"{path} is no BAM file")
            try:
                at = 8 + struct.unpack_from("<i", data, 4)[0]
                n, at, contigs = struct.unpack_from("<i", data, at)[0], at + 4, []
                for _ in range(n):
                    size = struct.unpack_from("<i", data, at)[0]
                    if len(data) < at + 8 + size:
                        raise struct.error
                    contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
                    at += 8 + size
            except struct.error:
                continue
            before, place = next((b, p) for b, p in reversed(parts) if b <= at)
            return contigs, place << 16 | at - before
    raise ValueError(f"{path} is no BAM file")


# -- indexes


class Index:
    """Bins with their chunks, by contig, and the least offsets of the records that reach into a place: a .bai's windows of 16,384 positions, or a .csi's bins."""

    def __init__(self, path: str):
        with open_file(path) as f:
            data = f.read()
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        kind, self.shift, self.depth, at = data[:4], 14, 5, 4
        if kind == b"CSI\1":
            self.shift, self.depth, aux = struct.unpack_from("<iii", data, 4)
            at = 16 + aux
        elif kind != b"BAI\1":
            raise ValueError(f"{path} is no index of a BAM file")
        csi = kind == b"CSI\1"
        counts = ((1 << 3 * self.depth + 3) - 1) // 7 + 1  # a bin that holds numbers, not chunks
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.least: list[dict[int, int]] = []
        self.windows: list[tuple[int, ...]] = []
        n_ref = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_ref):
            n_bins, own, least = struct.unpack_from("<i", data, at)[0], {}, {}
            at += 4
            for _ in range(n_bins):
                number = struct.unpack_from("<I", data, at)[0]
                at += 4
                if csi:
                    least[number] = struct.unpack_from("<Q", data, at)[0]
                    at += 8
                n = struct.unpack_from("<i", data, at)[0]
                if number != counts:
                    own[number] = [struct.unpack_from("<QQ", data, at + 4 + 16 * k) for k in range(n)]
                at += 4 + 16 * n
            self.bins.append(own)
            self.least.append(least)
            n = 0 if csi else struct.unpack_from("<i", data, at)[0]
            self.windows.append(() if csi else struct.unpack_from(f"<{n}Q", data, at + 4))
            at += 0 if csi else 4 + 8 * n

    def overlapping(self, start: int, end: int) -> Iterator[range]:
        """Numbers of the bins that hold records reaching into [start, end), level by level from the whole contig down."""
        first = 0
        for level in range(self.depth + 1):
            wide = self.shift + 3 * (self.depth - level)
            yield range(first + (start >> wide), first + min((end - 1) >> wide, (1 << 3 * level) - 1) + 1)
            first += 1 << 3 * level

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Chunks of the file with all records of the contig that overlap [start, end). What ends before the first record that reaches `start` is left out."""
        if ref >= len(self.bins) or end <= start:
            return []
        start, own = max(start, 0), self.bins[ref]
        low = 0
        if self.windows[ref]:
            w = self.windows[ref]
            if start >> 14 >= len(w):
                return []
            low = next((x for x in w[start >> 14 :] if x), 0)
        elif self.least[ref]:
            up = next(iter(list(self.overlapping(start, start + 1))[-1]))
            while up and up not in self.least[ref]:
                up = (up - 1) >> 3
            low = self.least[ref].get(up, 0)
        out = []
        for numbers in self.overlapping(start, end):
            few = numbers if len(numbers) <= len(own) else [b for b in own if b in numbers]
            out += [(max(a, low), b) for number in few for a, b in own.get(number, ()) if b > low]
        return merged(out)

    def splits(self) -> list[int]:
        """Offsets at which a record begins."""
        return sorted({a for own in self.bins for cs in own.values() for a, _ in cs} | {x for w in self.windows for x in w if x})


def merged(ranges: Iterable[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap, touch or share a block as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and (a <= out[-1][1] or a >> 16 <= (out[-1][1] >> 16) + gap):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def index_of(path: str) -> Index | None:
    """The index beside the file; one that is older than its file is used, with a warning."""
    stem = path.removesuffix(".bam")
    found = next((x for x in (f"{path}.bai", f"{stem}.bai", f"{path}.csi", f"{stem}.csi") if _exists(x)), None)
    if found is None:
        return None
    if "://" not in path and os.path.getmtime(found) < os.path.getmtime(path):
        warnings.warn(f"{found} is older than {path}", stacklevel=2)
    return Index(found)


# -- records


def _picked(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[starts[i] : starts[i] + sizes[i]] one after the other, and where each begins (one more at the end)."""
    ends = np.zeros(len(sizes) + 1, "i8")
    np.cumsum(sizes, out=ends[1:])
    if len(sizes) and (sizes == sizes[0]).all():  # reads of one length
        return np.lib.stride_tricks.sliding_window_view(data, int(sizes[0]))[starts].reshape(-1) if sizes[0] else data[:0], ends
    return data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _texts(data: np.ndarray, ends: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype("i8")), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
    return made if absent is None else pc.if_else(pa.array(absent), pa.scalar(None, pa.string()), made)


def _real_cigar(data: np.ndarray, start: int, end: int) -> np.ndarray | None:
    """The operations in the CG tag of a record whose optional fields are data[start:end]: those of alignments with more than 65,535."""
    raw, at = data[start:end].tobytes(), 0
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            n, item = struct.unpack_from("<i", raw, at + 1)[0], sizes[chr(raw[at])]
            if tag == b"CG":
                return np.frombuffer(raw, "<u4", n, at + 5)
            at += 5 + n * item
        else:
            at += sizes[kind]
    return None


class Decoder:
    """Arrow batches of records; remembers the texts of CIGARs that it has seen, up to `keep`."""

    def __init__(self, names: list[str], sample: str, keep: int = 50_000):
        self.names, self.sample, self.keep = pa.array([*names, None], pa.string()), sample, keep
        self.cigars: dict[bytes, str | None] = {}

    def _cigar(self, ops: bytes) -> str | None:
        if ops not in self.cigars:
            if len(self.cigars) >= self.keep:
                self.cigars.clear()
            self.cigars[ops] = "".join(f"{x >> 4}{OPS[x & 15]}" for (x,) in struct.iter_unpack("<I", ops)) or None
        return self.cigars[ops]

    def batch(self, data: np.ndarray, at: np.ndarray, order: np.ndarray, wanted=None) -> pa.RecordBatch:
        """data: inflated bytes; at: where records' sizes are; wanted(ref, start, end), if given, says which rows to build."""
        fixed = data[at[:, None] + np.arange(4, 36)].view("<i4")
        ref, pos = fixed[:, 0].astype("i8"), fixed[:, 1].astype("i8")
        n_name, mapq = fixed[:, 2] & 0xFF, fixed[:, 2] >> 8 & 0xFF
        n_ops, flag, n_seq = (fixed[:, 3] & 0xFFFF).astype("i8"), fixed[:, 3] >> 16 & 0xFFFF, fixed[:, 4].astype("i8")
        names = at + 36
        ops_at = names + n_name
        raw, ends = _picked(data, ops_at, 4 * n_ops)
        ops = raw.view("<u4").astype("i8")
        used = np.concatenate([[0], np.cumsum(np.where(ON_REFERENCE[ops & 15], ops >> 4, 0))])
        span = used[ends[1:] // 4] - used[ends[:-1] // 4]
        cigars = [self._cigar(b) for b in map(raw.tobytes().__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist()))]
        some = n_ops > 0
        seq_at = ops_at + 4 * n_ops
        packed = (n_seq + 1) // 2
        first = ops[np.minimum(ends[:-1] // 4, max(len(ops) - 1, 0))] if len(ops) else np.zeros(len(at), "i8")
        for i in np.nonzero((n_ops == 2) & (first == (n_seq << 4 | 4)) & (n_seq > 0))[0]:  # a stand-in: soft-clipped as a whole, then a skip
            end = at[i] + 4 + int(data[at[i] : at[i] + 4].view("<i4")[0])
            real = _real_cigar(data, seq_at[i] + packed[i] + n_seq[i], end)
            if real is not None:
                cigars[i] = self._cigar(real.tobytes())
                span[i] = int((real >> 4)[ON_REFERENCE[real & 15]].sum())
        if wanted is not None:
            rows = np.nonzero(wanted(ref, pos, np.where(some, pos + span, pos)))[0]
            ref, pos, span, mapq, flag, n_seq, packed, some, order = (x[rows] for x in (ref, pos, span, mapq, flag, n_seq, packed, some, order))
            names, n_name, seq_at = names[rows], n_name[rows], seq_at[rows]
            cigars = [cigars[i] for i in rows]
        letters, at_letter = LETTERS[_picked(data, seq_at, packed)[0]].reshape(-1), np.concatenate([[0], np.cumsum(n_seq)])
        if (n_seq & 1).any():  # the second half of a last byte is no letter
            letters, at_letter = _picked(letters, 2 * (np.cumsum(packed) - packed), n_seq)
        quals, ends = _picked(data, seq_at + packed, n_seq)
        no_quals = (n_seq == 0) | (quals[np.minimum(ends[:-1], max(len(quals) - 1, 0))] == 255 if len(quals) else True)
        if no_quals.any():
            quals, ends = _picked(data, seq_at + packed, np.where(no_quals, 0, n_seq))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(quals.astype("i4")), mask=pa.array(no_quals))
        n = len(ref)
        columns = [
            pa.array([self.sample] * n, pa.string()), pa.array(order.astype("i8")), _texts(*_picked(data, names, n_name - 1)), pa.array(flag.astype("i4")),
            self.names.take(pa.array(np.where(ref < 0, len(self.names) - 1, ref))), pa.array(pos), pa.array(pos + span, mask=~some), pa.array(mapq.astype("i4")), pa.array(cigars, pa.string()),
            _texts(letters, at_letter, n_seq == 0), lists,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["sample", "file_order", "query_name", "flag", "chrom", "ref_start", "ref_end", "mapq", "cigar", "seq", "quals"])


def record_batches(file, decoder: Decoder, start: int, stop: int | None, wanted=None, size: int = BATCH, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Records that begin at virtual offsets in [start, stop); file_order is that offset. About `size` inflated bytes, and the rest of a record that is begun, are held at a time."""
    held, parts, skip = b"", [], start & 0xFFFF  # parts: (where in held, place) of blocks
    source = blocks(file, start >> 16)
    more = True
    while more:
        fresh, length = [], len(held)
        while length < len(held) + size:
            got = next(source, None)
            if got is None:
                more = False
                break
            parts.append((length, got[0]))
            fresh.append(got[1])
            length += len(got[1])
            if stop is not None and got[0] > stop >> 16:
                break
        held = b"".join([held, *fresh])
        begins, at, done = [], skip, False
        last = len(held)
        known = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        limit = None
        if stop is not None and len(known[1]) and known[1][-1] >= stop >> 16:  # the first place in `held` where no record of ours begins
            i = int(np.searchsorted(known[1], stop >> 16))
            limit = int(known[0][i]) + ((stop & 0xFFFF) if known[1][i] == stop >> 16 else 0)
        unpack = struct.Struct("<i").unpack_from
        while at + 4 <= last:
            if limit is not None and at >= limit:
                done = True
                break
            end = at + 4 + unpack(held, at)[0]
            if end > last:
                break
            begins.append(at)
            at = end
        done = done or (limit is not None and at >= limit)
        if begins:
            data, where = np.frombuffer(held, "u1"), np.array(begins, "i8")
            block = np.searchsorted(known[0], where, side="right") - 1
            order = known[1][block] << 16 | where - known[0][block]
            for i in range(0, len(where), rows):
                out = decoder.batch(data, where[i : i + rows], order[i : i + rows], wanted)
                if out.num_rows:
                    yield out
        if done:
            return
        cut = [p for p in parts if p[0] <= at]
        parts = [(p[0] - at, p[1]) for p in parts if p[0] > at or p is cut[-1]] if cut else parts
        held, skip = held[at:], 0


class Wanted:
    """Rows that overlap one of the regions: {contig's number: sorted, disjoint (start, end)}."""

    def __init__(self, regions: dict[int, list[tuple[int, int]]]):
        self.regions = {r: np.array(spans, "i8").reshape(-1, 2) for r, spans in regions.items()}

    def __call__(self, ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ref), bool)
        for r, spans in self.regions.items():
            here = np.nonzero(ref == r)[0]
            i = np.searchsorted(spans[:, 1], start[here], side="right")  # the first region that ends beyond the read's start
            out[here] = (i < len(spans)) & (spans[np.minimum(i, len(spans) - 1), 0] < end[here])
        return out


class BamReader(DataSourceReader):
    """Options: `regions`, a JSON list of [chrom, start, end) (chr is put before names that the file lacks): only their reads; `splitBytes`, the size of a partition (32 MB unless given).

    Filters on chrom, and with one ref_start < x and ref_end > x, act as one region too; Spark applies those
    of ref_start and ref_end again. Without an index a file is one task that reads all of it.
    """

    def __init__(self, options: dict):
        self.paths = [options["path"]] if "://" in options["path"] else sorted(glob.glob(options["path"]))
        self.sample, self.size = options.get("sample", "N"), int(options.get("splitBytes", 32 << 20))
        self.regions = json.loads(options["regions"]) if "regions" in options else None
        self.chrom, self.before, self.after = None, None, 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and self.chrom in (None, f.value):
                self.chrom = f.value
                continue
            if isinstance(f, LessThan) and f.attribute == ("ref_start",):
                self.before = f.value if self.before is None else min(self.before, f.value)
            if isinstance(f, GreaterThan) and f.attribute == ("ref_end",):
                self.after = max(self.after, f.value)
            yield f

    def _spans(self, names: list[str]) -> dict[int, list[tuple[int, int]]] | None:
        """Disjoint spans by contig that reads must overlap; None for all reads."""
        if self.regions is None and self.chrom is None:
            return None
        numbers = {n: i for i, n in enumerate(names)}
        spans: dict[int, list[tuple[int, int]]] = {}
        for chrom, start, end in self.regions if self.regions is not None else [(self.chrom, 0, FAR)]:
            name = chrom if chrom in numbers or self.regions is None else "chrM" if chrom == "MT" else f"chr{chrom}"
            if name not in numbers or self.chrom not in (None, name):
                continue
            # ref_end > after lets reads in that end beyond it: they overlap [after, ...)
            low, high = max(start, self.after if self.chrom else 0), min(end, FAR if self.before is None or self.chrom is None else self.before)
            if low < high:
                spans.setdefault(numbers[name], []).append((low, high))
        return {r: merged_spans(s) for r, s in spans.items()}

    def plan(self, path: str) -> list[list[Range]]:
        """Ranges of virtual offsets for each partition."""
        contigs, first = header(path)
        index, spans = index_of(path), self._spans([n for n, _ in contigs])
        if spans is not None and not spans:
            return []
        if index is None:
            return [[(first, None)]]
        if spans is None:
            ranges: list[Range] = [(first, None)]
        else:
            ranges = list(merged(c for r, own in spans.items() for a, b in own for c in index.chunks(r, a, b)))
        cuts, at, out, held = index.splits(), 0, [], 0
        group: list[Range] = []
        for a, b in ranges:
            while True:
                while at < len(cuts) and cuts[at] <= a:
                    at += 1
                while at < len(cuts) and (b is None or cuts[at] < b) and (cuts[at] >> 16) - (a >> 16) + held < self.size:
                    at += 1
                cut = cuts[at] if at < len(cuts) and (b is None or cuts[at] < b) else None
                group.append((a, b if cut is None else cut))
                if cut is None:
                    held += (b >> 16) - (a >> 16) if b is not None else 0
                    break
                out.append(group)
                group, held, a = [], 0, cut
            if held >= self.size:
                out.append(group)
                group, held = [], 0
        return [g for g in [*out, group] if g]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((path, ranges)) for path in self.paths for ranges in self.plan(path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, ranges = partition.value
        names = [n for n, _ in header(path)[0]]
        spans, decoder = self._spans(names), Decoder(names, self.sample)
        with open_file(path) as file:
            for start, stop in ranges:
                yield from record_batches(file, decoder, start, stop, None if spans is None else Wanted(spans))


def balanced_splits(path: str, parts: int) -> list[list[tuple[str, int, int]]]:
    """The contigs cut into about `parts` lists of (chrom, start, end exclusive) whose records take about the same bytes of the file, largest first.

    Cuts lie where the index knows an offset (every 16,384 positions in a .bai), so a window that holds more
    than a share is a part of its own. Contigs without records go with their neighbours. A file without an index can't be cut.
    """
    contigs, first = header(path)
    index = index_of(path)
    if index is None:
        raise ValueError(f"{path} has no index")
    leaf = ((1 << 3 * index.depth) - 1) // 7
    known = []  # (contig, position, place in the file)
    for ref, (windows, least) in enumerate(zip(index.windows, index.least)):
        at = {w: x for w, x in enumerate(windows) if x} or {b - leaf: x for b, x in least.items() if leaf <= b < 8 * leaf + 1 and x}
        known += [(ref, w << index.shift, x >> 16) for w, x in sorted(at.items())]
    ends = [x[2] for x in known[1:]] + [max((b >> 16 for own in index.bins for cs in own.values() for _, b in cs), default=first >> 16)]
    own = [max(e - k[2], 0) for k, e in zip(known, ends)]
    share = max(sum(own) / parts, 1)
    cuts, sizes, before, part = [(0, 0)], [0], 0, 0
    for (ref, pos, _), size in zip(known, own):  # a window goes to the part that its middle lies in
        if (mine := min(int((before + size / 2) / share), parts - 1)) > part:
            if sizes[-1]:
                cuts.append((ref, pos))
                sizes.append(0)
            part = mine
        sizes[-1] += size
        before += size
    out = []
    for (r0, p0), (r1, p1) in zip(cuts, [*cuts[1:], (len(contigs), 0)]):
        spans = [(contigs[r][0], p0 if r == r0 else 0, p1 if r == r1 else contigs[r][1]) for r in range(r0, min(r1, len(contigs) - 1) + 1)]
        out.append([s for s in spans if s[1] < s[2]])
    return [spans for _, spans in sorted(zip(sizes, out), key=lambda x: -x[0]) if spans]


def merged_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str | StructType:
        return READS

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options)


def register(spark) -> None:
    """Makes format("bam") known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def contigs(spark, *paths: str):
    """(chrom, length) of the files' headers, each name once."""
    named = {n: size for path in paths for n, size in header(path)[0]}
    return spark.createDataFrame(list(named.items()), "chrom string, length long")
