"""Alignment files decoded in columns and read by region, the read store, FASTA by its index, and the sweep pileup."""

import gzip
import json
import random
import struct
import time
import warnings

import pytest
from pyspark.sql import functions as F
from test_files import packed, record, write_bam

from pilefold.operators.fourier import fourier_power
from pilefold.operators.intervals import with_reference
from pilefold.operators.pileup import aligned_bases, coverage, paired_coverage
from pilefold.operators.sweep import coverage_sweep, segments, sweep
from pilefold.plans import pipeline as P
from pilefold.schema import READS
from pilefold.sources import bam, fasta, store, text

SEQ, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def by_hand(path, sample="N"):
    """Rows of a BAM file, record by record."""
    data = gzip.decompress(path.read_bytes())
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    names, n = [], struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    rows = []
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        r, at = data[at + 4 : at + 4 + size], at + 4 + size
        ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", r)
        name, k = r[32 : 31 + n_name].decode(), 32 + n_name
        ops = struct.unpack_from(f"<{n_ops}I", r, k)
        k += 4 * n_ops
        seq = "".join(SEQ[b >> 4] + SEQ[b & 15] for b in r[k : k + (n_seq + 1) // 2])[:n_seq]
        quals = list(r[k + (n_seq + 1) // 2 :][:n_seq])
        end = pos + sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X") if ops else None
        rows.append((sample, name, flag, names[ref] if ref >= 0 else None, pos, end, mapq, "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or None, seq or None, None if not quals or quals[0] == 255 else quals))
    return rows


def random_rows(rng, n, contigs=2, size=90_000):
    rows = []
    for i in range(n):
        ops = rng.choice([[(30, "M")], [(5, "S"), (20, "M"), (3, "I"), (10, "M")], [(10, "M"), (4, "D"), (10, "="), (2, "X"), (3, "H")], [(1, "M"), (500, "N"), (8, "M")], []])
        length = sum(k for k, o in ops if o in "MIS=X") or rng.choice([0, 7])
        rows.append((rng.randrange(contigs), rng.randrange(size), f"read{i}" * rng.randrange(1, 3), rng.choice([0, 16, 4, 1024]), ops, "".join(rng.choice("ACGTN") for _ in range(length)), rng.choice([40, 255, 2]), rng.randrange(61)))
    return sorted(rows, key=lambda r: r[:2])


def reg2bin(start, end, shift=14, depth=5):
    """The smallest bin that holds [start, end)."""
    end -= 1
    first = ((1 << 3 * depth) - 1) // 7
    for level in range(depth, 0, -1):
        wide = shift + 3 * (depth - level)
        if start >> wide == end >> wide:
            return first + (start >> wide)
        first -= 1 << 3 * (level - 1)
    return 0


def write_indexed(path, contigs, rows, per_block=4, csi=False, shift=14, depth=5):
    """A sorted BAM whose index has each record's own bin; records may reach over blocks."""
    out = packed(b"BAM\1" + struct.pack("<ii", 0, len(contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs))
    left, places, starts = b"", [], []
    for i in range(0, len(rows), per_block):
        block = left
        starts.append(len(out))
        for row in rows[i : i + per_block]:
            places.append((len(starts) - 1, len(block)))
            block += record(*row)
        left = block[-5:] if i + per_block < len(rows) else b""
        out += packed(block[: len(block) - len(left)])
        if i % (3 * per_block) == 0:
            out += packed(b"")  # blocks without data may stand anywhere
    offsets = [starts[b] << 16 | k for b, k in places] + [len(out) << 16]
    out += packed(b"")
    path.write_bytes(out)
    bins, windows = [{} for _ in contigs], [{} for _ in contigs]
    for row, a, b in zip(rows, offsets, offsets[1:]):
        ref, pos, ops = row[0], row[1], row[4]
        end = pos + max(1, sum(k for k, o in ops if o in "MDN=X"))
        chunks = bins[ref].setdefault(reg2bin(pos, end, shift, depth), [])
        if chunks and chunks[-1][1] == a:
            chunks[-1] = (chunks[-1][0], b)
        else:
            chunks.append((a, b))
        for w in range(pos >> shift, (end - 1 >> shift) + 1):
            windows[ref].setdefault(w, a)
    data = b"CSI\1" + struct.pack("<iii", shift, depth, 0) if csi else b"BAI\1"
    data += struct.pack("<i", len(contigs))
    for own, win in zip(bins, windows):
        data += struct.pack("<i", len(own) + 1)
        for number, chunks in own.items():
            level_first, level = 0, 0
            while level < depth and number >= level_first + (1 << 3 * level):
                level_first += 1 << 3 * level
                level += 1
            wide = shift + 3 * (depth - level)
            low = min((a for w, a in win.items() if w >= (number - level_first) << (wide - shift)), default=0)
            data += struct.pack("<I", number) + (struct.pack("<Q", low) if csi else b"") + struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        data += struct.pack("<I", ((1 << 3 * depth + 3) - 1) // 7 + 1) + (struct.pack("<Q", 0) if csi else b"") + struct.pack("<iQQQQ", 2, 0, 0, 0, 0)
        if not csi:
            n = max(win, default=-1) + 1
            data += struct.pack("<i", n) + b"".join(struct.pack("<Q", win.get(w, 0)) for w in range(n))
    path.with_name(path.name + (".csi" if csi else ".bai")).write_bytes(packed(data) if csi else data)
    return starts


def plain(df):
    return [tuple(r[c] for c in ("sample", "query_name", "flag", "chrom", "ref_start", "ref_end", "mapq", "cigar", "seq", "quals")) for r in df.orderBy("file_order").collect()]


@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_columns_against_records(tmp_path, size, monkeypatch):
    """Batches of any size, records over blocks, blocks without data, no CIGAR, no bases, no qualities, unmapped."""
    rows = random_rows(random.Random(size), 150) + [(-1, -1, "lost", 4, [], "ACGTA", 255), (-1, -1, "bare", 4, [], "", 40)]
    write_indexed(tmp_path / "a.bam", [("1", 100_000), ("2", 100_000)], [r for r in rows if r[0] >= 0])
    contigs, first = bam.header(str(tmp_path / "a.bam"))
    assert contigs == [("1", 100_000), ("2", 100_000)]
    got = []
    with open(tmp_path / "a.bam", "rb") as file:
        for b in bam.record_batches(file, bam.Decoder(["1", "2"], "N"), first, None, size=size, rows=13):
            got += [tuple(r[c] for c in ("sample", "query_name", "flag", "chrom", "ref_start", "ref_end", "mapq", "cigar", "seq", "quals")) for r in b.to_pylist()]
    assert got == by_hand(tmp_path / "a.bam")


def test_unmapped_and_empty_files(spark, tmp_path):
    bam.register(spark)
    write_bam(tmp_path / "u.bam", [("1", 100)], [(0, 5, "x", 0, [(2, "M")], "AC")])
    (tmp_path / "u.bam").write_bytes((tmp_path / "u.bam").read_bytes()[:-28] + packed(record(-1, -1, "lost", 4, [], "ACGTA", 255)) + packed(b""))
    got = spark.read.format("bam").load(str(tmp_path / "u.bam"))
    assert plain(got) == by_hand(tmp_path / "u.bam") and len(plain(got)) == 2
    write_bam(tmp_path / "e.bam", [("1", 100)], [])
    assert spark.read.format("bam").load(str(tmp_path / "e.bam")).count() == 0
    (tmp_path / "no.bam").write_bytes(packed(b"nothing"))
    with pytest.raises(ValueError):
        bam.header(str(tmp_path / "no.bam"))


@pytest.mark.parametrize("csi, shift, depth", [(False, 14, 5), (True, 14, 5), (True, 12, 6)])
def test_regions_by_bins(spark, tmp_path, csi, shift, depth):
    """Any list of regions gives the reads that overlap one, and reads the blocks of its bins only: all others are overwritten with what can't be inflated."""
    bam.register(spark)
    rng = random.Random(shift + csi)
    rows = random_rows(rng, 400, size=900_000)
    path = tmp_path / "a.bam"
    write_indexed(path, [("1", 1_000_000), ("chr2", 1_000_000), ("3", 10)], rows, csi=csi, shift=shift, depth=depth)
    everything = [r for r in by_hand(path) if r[5] is not None]
    whole = path.read_bytes()
    for trial in range(6):
        regions = [[rng.choice(["1", "2", "chr2", "3", "none"]), a, a + rng.choice([1, 300, 40_000])] for a in (rng.randrange(900_000) for _ in range(rng.choice([1, 4, 30])))]
        reader = bam.BamReader({"path": str(path), "regions": json.dumps(regions), "splitBytes": "2000"})
        kept = bytearray(b"\xff" * len(whole))
        head = next(p for p, b in bam.blocks(open(path, "rb"), 0) if p)
        kept[:head] = whole[:head]
        asked = [r for p in reader.plan(str(path)) for r in p]
        places = [p for p, _ in bam.blocks(open(path, "rb"), 0)] + [len(whole)]
        for a, b in asked:
            last = next((p for p in places if p > b >> 16), len(whole))
            last = next((p for p in places if p > last), len(whole))  # the block after, where a record begun before may end, or an empty one
            kept[a >> 16 : last] = whole[a >> 16 : last]
        (tmp_path / "cut.bam").write_bytes(kept)
        for end in (".bai", ".csi"):
            if (tmp_path / f"a.bam{end}").exists():
                (tmp_path / f"cut.bam{end}").write_bytes((tmp_path / f"a.bam{end}").read_bytes())
        inside = lambda r: any((c if c in ("1", "chr2", "3") else f"chr{c}") == r[3] and r[4] < e and max(r[5], r[4] + 0) > s for c, s, e in regions)  # noqa: B023, E731
        for split in (2000, 1 << 20):
            got = spark.read.format("bam").option("regions", json.dumps(regions)).option("splitBytes", split).load(str(tmp_path / "cut.bam"))
            assert sorted(map(str, plain(got.filter("ref_end is not null")))) == sorted(str(r) for r in everything if inside(r)), (trial, split)
        if len(regions) == 1:
            assert sum((b >> 16) - (a >> 16) for a, b in asked) < 0.3 * len(whole)


def test_one_gene_reads_its_blocks(tmp_path, monkeypatch):
    """Bytes counted: a region of 2,000 positions in a file of 2,000 records."""
    rows = [(0, 50 * i, f"r{i}", 0, [(30, "M")], "ACGTACGTAC" * 3) for i in range(20_000)]
    write_indexed(tmp_path / "a.bam", [("1", 2_000_000)], rows, per_block=40)
    read = []

    class Counted:
        def __init__(self, path):
            self.file = open(path, "rb")

        def read(self, n=-1):
            out = self.file.read(n)
            read.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "regions": json.dumps([["1", 500_000, 502_000]])})
    parts = reader.partitions()
    monkeypatch.setattr(bam, "open_file", Counted)
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["query_name"] for r in got] == [f"r{i}" for i in range(10_000, 10_040)]
    assert sum(read) < 0.05 * (tmp_path / "a.bam").stat().st_size


def test_an_old_index_is_noticed(tmp_path):
    import os

    write_bam(tmp_path / "a.bam", [("1", 100)], [(0, 5, "x", 0, [(2, "M")], "AC")])
    os.utime(tmp_path / "a.bam.bai", (1, 1))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        bam.index_of(str(tmp_path / "a.bam"))
    assert len(seen) == 1 and "older" in str(seen[0].message)


def test_more_operations_than_a_record_holds(spark, tmp_path):
    """The CG tag has the operations of an alignment with more than 65,535; other tags of every kind go before it."""
    bam.register(spark)
    real = [(1, "M"), (1, "I")] * 40_000
    n = 80_000
    r = bytearray(record(0, 7, "long", 0, [(n, "S"), (40_000, "N")], "AC" * 40_000)[4:])
    r += b"NMi" + struct.pack("<i", 5) + b"RGZgroup\0" + b"XCc\1" + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"CGBI" + struct.pack("<i", len(real)) + b"".join(struct.pack("<I", k << 4 | OPS.index(o)) for k, o in real)
    (tmp_path / "a.bam").write_bytes(packed(b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 99_999)))
    data = struct.pack("<i", len(r)) + bytes(r) + record(0, 9, "short", 0, [(2, "S"), (4, "N")], "AC")
    with open(tmp_path / "a.bam", "ab") as f:
        for i in range(0, len(data), 60_000):
            f.write(packed(data[i : i + 60_000]))
        f.write(packed(b""))
    long, short = plain(spark.read.format("bam").load(str(tmp_path / "a.bam")))
    assert long[7] == "1M1I" * 40_000 and (long[4], long[5]) == (7, 40_007) and len(long[8]) == n
    assert short[7] == "2S4N" and short[5] == 13


def test_columns_are_faster_than_records(tmp_path):
    rng = random.Random(1)
    rows = [(0, i, f"read{i}", 0, [(100, "M")], "".join(rng.choices("ACGT", k=100))) for i in range(5000)] * 8
    write_bam(tmp_path / "a.bam", [("1", 100_000)], rows, per_block=200)
    began = time.time()
    want = by_hand(tmp_path / "a.bam")
    slow, began = time.time() - began, time.time()
    with open(tmp_path / "a.bam", "rb") as file:
        n = sum(b.num_rows for b in bam.record_batches(file, bam.Decoder(["1"], "N"), bam.header(str(tmp_path / "a.bam"))[1], None))
    fast = time.time() - began
    assert n == len(want) == 40_000 and fast * 2 < slow, (fast, slow)


@pytest.mark.parametrize("csi", [False, True])
def test_splits_of_equal_bytes(tmp_path, csi):
    """Half of all records on a tenth of the genome: the parts cover every position once, and none takes over 1.2 times the mean."""
    rng = random.Random(7)
    rows = sorted((0, rng.randrange(2_000_000) if i % 2 else 900_000 + rng.randrange(250_000), f"r{i}", 0, [(30, "M")], "".join(rng.choices("ACGT", k=30))) for i in range(6000))
    rows += sorted((2, rng.randrange(500_000), f"s{i}", 0, [(30, "M")], "".join(rng.choices("ACGT", k=30))) for i in range(1500))
    write_indexed(tmp_path / "a.bam", contigs := [("1", 2_000_000), ("empty", 70_000), ("3", 500_000), ("last", 10)], rows, per_block=10, csi=csi)
    parts = bam.balanced_splits(str(tmp_path / "a.bam"), 6)
    spans = sorted(s for p in parts for s in p)
    for name, size in contigs:
        own = [s[1:] for s in spans if s[0] == name]
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    size = lambda p: sum(len(record(*r)) for r in rows if any(contigs[r[0]][0] == c and a <= r[1] < e for c, a, e in p))
    sizes = [size(p) for p in parts]
    assert len(parts) == 6 and max(sizes) <= 1.2 * sum(sizes) / len(sizes), sizes
    with pytest.raises(ValueError):
        (tmp_path / "b.bam").write_bytes((tmp_path / "a.bam").read_bytes())
        bam.balanced_splits(str(tmp_path / "b.bam"), 3)


# -- the store


def test_store_decodes_once(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    for name in ("n", "t"):
        write_indexed(tmp_path / f"{name}.bam", [("1", 100_000), ("2", 100_000)], random_rows(rng, 200))
    n, t, out = str(tmp_path / "n.bam"), str(tmp_path / "t.bam"), str(tmp_path / "out")
    first = store.stored_reads(spark, n, t, out)
    want = sorted(map(str, by_hand(tmp_path / "n.bam") + by_hand(tmp_path / "t.bam", "T")))
    assert sorted(map(str, plain(first))) == want and first.columns == [f.split()[0] for f in READS.split(", ")]
    beds = spark.createDataFrame([("1", 20_000, 20_100), ("2", 5, 50)], "chrom string, start long, end long")
    some = store.stored_reads(spark, n, t, out, beds)
    near = lambda r: r[5] is not None and any(c == r[3] and r[4] < e + store.MARGIN and r[5] > s - store.MARGIN for c, s, e in [("1", 20_000, 20_100), ("2", 5, 50)])
    assert sorted(map(str, plain(some.filter("ref_end is not null")))) == sorted(str(r) for r in by_hand(tmp_path / "n.bam") + by_hand(tmp_path / "t.bam", "T") if near(r))
    monkeypatch.setattr(store.bam, "register", None)  # the second time no file is opened
    again = store.stored_reads(spark, n, t, out)
    assert sorted(map(str, plain(again))) == want
    plan = again.filter("sample = 'N' and chrom = '1' and ref_start < 500 and ref_end > 100")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "LessThan(ref_start,500)" in plan
    with open(n, "ab") as f:
        f.write(packed(b""))  # another file now
    with pytest.raises(TypeError):
        store.stored_reads(spark, n, t, out)


def test_regions_give_the_same_candidates(spark):
    """Reads, regions and a leading clip that moves an event over a border of bins: with and without the store's limits."""
    reads = []
    for s, k in (("N", 0), ("T", 6)):
        for i in range(8):
            cigar = "900S30M2D30M" if i < k else "960M"
            reads.append((s, i, f"{s}{i}", 0, "chr1", 1000, 1062 if i < k else 1960, 60, cigar, "A" * 960, [40] * 960))
    df = spark.createDataFrame(reads, READS)
    regions = lambda *r: spark.createDataFrame(list(r), "chrom string, start long, end long")
    names = spark.createDataFrame([("chr1", 9999)], "chrom string, length long")
    assert [tuple(r) for r in P.indel_candidates(df).collect()] == [("chr1", 1929)]
    assert P.indel_candidates(df, regions=regions(("1", 1050, 1940)), contigs=names).collect() == P.indel_candidates(df).collect()
    assert P.indel_candidates(df, regions=regions(("1", 1050, 1930))).collect() == []  # the region's last base is left out
    assert P.indel_candidates(df, regions=regions(("1", 1100, 1940))).collect() == []  # no read that has the event overlaps it


# -- FASTA


def test_fasta_by_index(spark, tmp_path):
    """Blocks by byte arithmetic, the bytes of all others being no text; a short last line, one line in all, line ends of two bytes."""
    rng = random.Random(2)
    want = {"1": 500, "two": 7, "chr3": 64, "MT": 61}
    want = {k: "".join(rng.choice("acgtN") for _ in range(n)) for k, n in want.items()}
    data, index = b"", ""
    for k, (end, per) in zip(want, [(b"\n", 30), (b"\n", 60), (b"\r\n", 16), (b"\n", 61)]):
        data += f">{k} text".encode() + end
        index += f"{k}\t{len(want[k])}\t{len(data)}\t{per}\t{per + len(end)}\n"
        data += b"".join(want[k][i : i + per].encode() + end for i in range(0, len(want[k]), per))
    (tmp_path / "a.fa").write_bytes(data)
    (tmp_path / "a.fa.fai").write_text(index)
    ref = fasta.IndexedFasta(spark, str(tmp_path / "a.fa"), 16)
    assert {r["chrom"]: r["length"] for r in ref.contigs.collect()} == {k: len(s) for k, s in want.items()}
    every = spark.createDataFrame([(k, b) for k in [*want, "none"] for b in range(-1, 40)], "chrom string, b long")
    got = {(r["chrom"], r["block_start"]): r["seq"] for r in ref.blocks(every.union(every)).collect()}
    assert got == {(k, a): s[a : a + 16] for k, s in want.items() for a in range(0, len(s), 16)}
    sites = spark.createDataFrame([("1", 15, 3), ("1", 499, 1), ("chrM", 0, 61), ("3", 1, 2), ("chr3", 62, 9)], "chrom string, pos long, n long")
    ask = lambda r: sorted(map(str, with_reference(sites, r, F.col("n"), 16).collect()))
    assert ask(ref) == ask(text.read_fasta(spark, str(tmp_path / "a.fa"), 16))
    first = int(index.split("\t")[2])
    at = first + 160 // 30 * 31 + 160 % 30
    (tmp_path / "a.fa").write_bytes(bytes(b if at <= i <= at + 16 else 0xFF for i, b in enumerate(data)))
    one = spark.createDataFrame([("1", 160)], "chrom string, pos long")
    assert with_reference(one, ref, F.lit(4), 16).first()["ref"] == want["1"][160:164].upper()


# -- sweep


def test_segments():
    assert segments("5H2S3M1I4=2D1X7N2M6S1P").tolist() == [[0, 2, 3], [3, 6, 4], [9, 10, 1], [17, 11, 2]]
    assert segments("5S3I").tolist() == []


@pytest.mark.parametrize("far", [3000, 10**9])
def test_sweep_against_bases(spark, far):
    rng = random.Random(far)
    rows = []
    for i in range(600):
        cigar = rng.choice(["20M", "3S10M2I5M", "6M4D14M", "1M900N1M", "2=1X5M3S", "20S", "4I", "5M1P3M"])
        n = sum(int(k) for k, o in __import__("re").findall(r"(\d+)([MIS=X])", cigar))
        seq = "".join(rng.choice("ACGTacgtN") for _ in range(n))
        quals = rng.choice([None, [rng.randrange(15, 41) for _ in range(n)], [rng.randrange(15, 41) for _ in range(n // 2)]])
        rows.append((rng.choice("NT"), i, f"r{i}", rng.choice([0, 16]), rng.choice(["1", "2"]), rng.randrange(far), None, rng.randrange(60), cigar, seq, quals))
    rows += [("T", 900, "n", 0, "1", 5, None, 60, None, None, None), ("T", 901, "n", 0, None, 5, None, 60, "2M", "AC", [40, 40])]
    reads = spark.createDataFrame(rows, READS)
    key = lambda df: sorted(map(str, df.collect()))
    some = reads.filter("chrom is not null")
    assert key(coverage_sweep(reads, 22)) == key(coverage(aligned_bases(some), 22, 0))
    assert key(sweep(reads, 22)) == key(paired_coverage(aligned_bases(some), 22, 0))
    sites = spark.createDataFrame([("1", r[5] + 2) for r in rows[:50]] + [("2", 1)], "chrom string, pos long")
    assert key(sweep(reads, 22, sites)) == key(paired_coverage(aligned_bases(some), 22, 0).join(sites.distinct(), ["chrom", "pos"], "left_semi"))
    assert coverage_sweep(reads.limit(0)).count() == 0


# -- Fourier power


def test_fourier_power_by_direct_sums(spark):
    import cmath

    rng = random.Random(9)
    seq = {"1": "".join(rng.choice("ACGTacgtN") for _ in range(53)), "2": "ACG" * 7, "3": "ACGT"}
    blocks = [(k, a, s[a : a + 16]) for k, s in seq.items() for a in range(0, len(s), 16)] + [("1", 160, "ACGTACGTACGTACGT")]
    df = spark.createDataFrame(blocks, "chrom string, block_start long, seq string")
    for n, k in ((12, 4), (9, 2), (16, 1)):
        got = {(r["chrom"], r["pos"]): r["power"] for r in fourier_power(df, 16, n, k).collect()}
        runs = [(c, 0, s) for c, s in seq.items()] + [("1", 160, "ACGTACGTACGTACGT")]
        want = {(c, a + p): sum(abs(sum(cmath.exp(-2j * cmath.pi * k * j / n) for j in range(n) if s[p + j].upper() == b)) ** 2 for b in "ACGT") for c, a, s in runs for p in range(len(s) - n + 1)}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    with pytest.raises(ValueError):
        fourier_power(df, 4)
