"""Micro-fixtures: expected values worked out by hand."""

import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilefold.config import Calling
from pilefold.functions import cigar as C
from pilefold.functions import encode as E
from pilefold.operators import calls as K
from pilefold.operators import candidates as N
from pilefold.operators import evaluate as V
from pilefold.operators import intervals as I
from pilefold.operators import pileup as P
from pilefold.operators import rows as R
from pilefold.operators import scoring as S
from pilefold.operators import tensors as M
from pilefold.plans import pipeline
from pilefold.schema import READS
from pilefold.sources import bam, text


def read(sample, cigar, start=100, mapq=40, flag=0, seq=None, name=None, order=0, chrom="1", quals=None):
    n = sum(int(k) for k, op in __import__("re").findall(r"(\d+)([MIS=X])", cigar))
    span = sum(int(k) for k, op in __import__("re").findall(r"(\d+)([MDN=X])", cigar))
    return (sample, order, name or f"r{order}", flag, chrom, start, start + span, mapq, cigar, seq or ("ACGT" * n)[:n], quals or [30] * n)


@pytest.mark.parametrize("cigar,want", [("10M2I10M", [("I", 110)]), ("10M3D10M", [("D", 110)]), ("10M2I5M1D5M", [("I", 110), ("D", 115)]), ("5S10M2I8M", [("I", 115)]), ("20M", [])])
def test_indel_positions(spark, cigar, want):
    got = N.indel_events(spark.createDataFrame([read("T", cigar)], READS)).orderBy("pos").collect()
    assert [(r["op"], r["pos"]) for r in got] == want


@pytest.mark.parametrize("mapq,flag,n", [(34, 0, 0), (35, 0, 1), (40, 0x400, 0), (40, 0x100, 0), (40, 0x800, 0), (40, 0x4, 0)])
def test_indel_reads(spark, mapq, flag, n):
    assert N.indel_events(spark.createDataFrame([read("T", "10M2I10M", mapq=mapq, flag=flag)], READS)).count() == n


@pytest.mark.parametrize("t,n,kept", [((2, 0), None, True), ((1, 1), None, False), ((2, 1), None, True), ((5, 0), (2, 0), False), ((6, 0), (2, 0), True), ((2, 0), (1, 1), True), ((2, 0), (6, 0), True)])
def test_indel_rule(spark, t, n, kept):
    rows = [("T", "1", 10, op) for op, k in zip("ID", t) for _ in range(k)] + [("N", "1", 10, op) for op, k in zip("ID", n or (0, 0)) for _ in range(k)]
    events = spark.createDataFrame(rows, "sample string, chrom string, pos long, op string")
    assert (N.indel_candidates(N.indel_evidence(events)).count() == 1) is kept


@pytest.mark.parametrize("n,t,want", [([10, 0, 0, 0], [26, 2, 0, 0], 1), ([10, 0, 0, 0], [27, 1, 0, 0], 0), ([10, 0, 0, 0], [55, 0, 2, 0], 1), ([10, 0, 0, 0], [56, 0, 2, 0], 0), ([19, 1, 0, 0], [20, 5, 0, 0], 1), ([18, 1, 0, 0], [20, 5, 0, 0], 0), ([6, 0, 0, 0], [20, 5, 0, 0], 0), ([5, 5, 0, 0], [20, 9, 0, 0], 0)])
def test_snv_rule(spark, n, t, want):
    rows = [(s, "1", 5, 60, 40, False, b) for s, c in (("N", n), ("T", t)) for b, k in enumerate(c) for _ in range(k)]
    assert N.snv_candidates(spark.createDataFrame(rows, "sample string, chrom string, pos long, mapq int, baseq int, is_reverse boolean, base int")).count() == want


@pytest.mark.parametrize("ref,counts,want", [("C", [3, 3, 1, 0], ("A", 7, 3, 3, 0.4286)), ("A", [3, 3, 1, 0], ("A", 7, 3, 3, 0.4286)), ("A", [93, 3, 0, 0], ("C", 96, 93, 3, 0.0312)), ("N", [3, 3, 1, 0], ("N", 7, 0, 0, 0.0)), ("A", [0, 0, 0, 0], ("A", 0, 0, 0, 0.0))])
def test_snv_stats(spark, ref, counts, want):
    r = K.with_snv_stats(spark.createDataFrame([(ref, counts)], "ref string, counts array<long>")).first()
    assert (r["alt"], r["dp"], r["ro"], r["ao"], r["af"]) == want


@pytest.mark.parametrize("kind,want", [("I", (10, 9, 3, 0.3, "I", "GT", 2)), ("D", (10, 6, 3, 0.3, "D", None, 2))])
def test_indel_stats(spark, kind, want):
    called = [read("T", "10M2I10M", seq="A" * 10 + "GT" + "A" * 10, order=i) if kind == "I" else read("T", "10M2D10M", order=i) for i in range(3)]
    rows = called + [read("T", "10M1D10M", order=3)] + [read("T", "22M", order=i) for i in range(4, 9)] + [read("T", "22M", flag=0x400, order=9)]
    met = spark.createDataFrame(rows, READS).withColumn("pos", F.lit(109).cast("long"))
    r = K.indel_stats(K.read_evidence(met)).first()
    # A read whose next pair after an insertion is the next position supports the reference too; one with a deletion doesn't.
    assert (r["dp"], r["ro"], r["ao"], r["af"], r["kind"], r["seq"], r["len"]) == want


@pytest.mark.parametrize("at,snp,indel,n,rejected", [(99, 0.2, 0, 0, 1), (100, 0.2, 0, 0, 1), (101, 0.2, 0, 0, 1), (98, 0.2, 0, 0, 0), (100, 0.1, 0, 0, 0), (95, 0, 0.2, 4, 1), (95, 0, 0.2, 3, 0), (95, 0.3, 0.2, 4, 0), (91, 0, 0.2, 8, 1), (90, 0, 0.9, 50, 0)])
def test_germline(spark, at, snp, indel, n, rejected):
    normal = spark.createDataFrame([("1", at, float(snp), float(indel), n)], "chrom string, pos long, snp_af double, indel_af double, indel_len int")
    assert K.germline_rejected(spark.createDataFrame([("1", 100)], "chrom string, pos long"), normal).count() == rejected


@pytest.mark.parametrize("length,n,last", [(9, 1, (0, 8)), (100, 10, (90, 99)), (101, 11, (100, 100)), (25, 13, (24, 24)), (19, 19, (18, 18))])
def test_split(spark, length, n, last):
    got = I.split_contigs(spark.createDataFrame([("1", length)], "chrom string, length long")).orderBy("start").collect()
    assert len(got) == n and (got[-1]["start"], got[-1]["end"]) == last


def test_batches(spark):
    bed = spark.createDataFrame([(i, "1", 10 * i, 10 * i + k) for i, k in enumerate((6, 6, 6, 1))], "idx long, chrom string, start long, end long")
    assert [r["batch_id"] for r in I.batch_regions(bed, 10).orderBy("idx").collect()] == [0, 0, 1, 1]
    bed = spark.createDataFrame([(0, "1", 0, 10), (1, "1", 20, 25), (2, "1", 30, 35), (3, "1", 40, 41)], "idx long, chrom string, start long, end long")
    assert [r["batch_id"] for r in I.batch_regions(bed, 10).orderBy("idx").collect()] == [0, 1, 1, 2]  # a batch that has just the limit is closed
    assert I.batch_regions(bed.limit(0), 10).count() == 0


def test_rounding(spark):
    ratios = spark.range(1, 601).withColumnRenamed("id", "d").withColumn("a", F.explode(F.sequence(F.lit(0), "d")))
    got = ratios.select("a", "d", E.ratio4(F.col("a"), F.col("d")).alias("r"), E.number_text(F.col("a") / F.col("d")).alias("t")).toPandas()
    want = [round(a / d, 4) for a, d in zip(got["a"].tolist(), got["d"].tolist())]
    assert got["r"].tolist() == want and got["t"].tolist() == [repr(w) for w in want]


@pytest.mark.parametrize("start,end,last,kept", [(99, 100, False, 0), (100, 102, False, 1), (100, 101, False, 0), (100, 101, True, 1), (95, 100, False, 0), (95, 101, False, 0), (95, 102, False, 1)])
def test_indels_in_regions(spark, start, end, last, kept):
    """Two reads with an event at 100: the region tests that, and leaves its last base out."""
    reads = spark.createDataFrame([read("T", "10M2I10M", start=90, order=i, chrom="chr1") for i in range(2)], READS)
    for name in ("1", "chr1"):
        bed = spark.createDataFrame([(name, start, end)], "chrom string, start long, end long")
        assert [tuple(r) for r in pipeline.indel_candidates(reads, regions=bed, keep_last=last).collect()] == [("chr1", 99)] * kept


def test_contig_fallback(spark):
    ref = spark.createDataFrame([("1", 0, "acgt"), ("MT", 0, "ggca"), ("chr2", 0, "tttt")], "chrom string, block_start long, seq string")
    sites = spark.createDataFrame([("chr1", 1), ("1", 1), ("chrM", 2), ("M", 2), ("MT", 2), ("chr2", 0), ("2", 0)], "chrom string, pos long")
    got = {r["chrom"]: r["ref"] for r in I.with_reference(sites, ref, F.lit(1), 4).collect()}
    assert got == {"chr1": "C", "1": "C", "chrM": "C", "M": "C", "MT": "C", "chr2": "T", "2": ""}


def test_call_without_depth(spark):
    """Secondary reads make a candidate, which the default pileup then doesn't cover."""
    ref = spark.createDataFrame([("1", 0, "ACGT" * 100)], "chrom string, block_start long, seq string")
    reads = spark.createDataFrame([read("T", "40M", flag=0x100, order=i) for i in range(9)], READS)
    p = spark.createDataFrame([("1", 121, 0.9)], "chrom string, pos long, pred_true double")
    r = pipeline.call(p, None, reads, ref, 400).first()
    assert (r["pos"], r["ref"], r["alt"], r["info"], r["sample"]) == (122, "C", "A", "TYPE=SNV;SCORE=0.9;DP=0;RO=0;AO=0;AF=0;", "0/1:0:0:0:0")


def test_colours(spark):
    q = [0, 2, 10, 20, 22, 30, 35, 40, 45, 60]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, q int").orderBy("i").select(E.quality_colour(F.col("q"))).collect()
    assert [r[0] for r in got] == [0, 11, 56, 113, 124, 170, 198, 226, 255, 255]
    assert M.shade(32.5) == 184
    assert spark.range(1).select(E.mapq_colour(F.lit(255))).first()[0] == 0


def test_sampling():
    assert R.sample_indices(12, 5, 1) == [1, 2, 4, 9, 10]
    assert set(range(101)) - set(R.sample_indices(101, 100, 1)) == {84}
    assert set(range(141)) - set(R.sample_indices(141, 140, 1)) == {9}
    assert R.sample_indices(3, 5, 1) == [0, 1, 2]


def test_scores_and_vcf(spark):
    rows = spark.createDataFrame([("1", 10, 0.29996), ("1", 11, 0.49996), ("1", 12, 0.2999)], "chrom string, pos long, pred_true double")
    assert [(r["pos"], r["filter"]) for r in K.scored(rows, Calling()).orderBy("pos").collect()] == [(10, "REJECT"), (11, "PASS")]
    counted = spark.createDataFrame([("1", 10, "A", [93, 3, 0, 0]), ("1", 11, "A", [9, 0, 0, 0]), ("1", 12, "A", [159, 1, 0, 0]), ("1", 13, "N", [4, 0, 0, 0])], "chrom string, pos long, ref string, counts array<long>")
    calls = K.with_snv_stats(counted).withColumns({"score": F.when(F.col("pos") == 10, 0.4583).otherwise(1.0), "filter": F.lit("REJECT")})
    got = K.vcf_rows(calls, "SNV").orderBy("pos").collect()
    assert got[0]["info"] == "TYPE=SNV;SCORE=0.4583;DP=96;RO=93;AO=3;AF=0.0312;" and got[0]["pos"] == 11
    assert [r["sample"] for r in got[1:]] == ["0/1:9:9:0:0.0", "0/1:160:159:1:0.0063", "0/1:4:0:0:0"] and "SCORE=1.0;" in got[1]["info"]


def test_pr_curve(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "score double, label int")
    got = V.pr_curve(df).orderBy(F.desc("threshold")).collect()
    assert [(round(r["precision"], 4), r["recall"], round(r["f1"], 4)) for r in got] == [(1.0, 0.5, 0.6667), (0.5, 0.5, 0.5), (0.6667, 1.0, 0.8)]
    assert V.best_threshold(V.pr_curve(df)).first()["threshold"] == 0.7


def test_read_dedupe(spark):
    rows = [("1", 5, "N", "x", 0, 0x400), ("1", 5, "N", "x", 1, 0), ("1", 5, "N", "x", 2, 0)]
    from pilefold.operators.pileup import is_usable

    df = spark.createDataFrame(rows, "chrom string, pos long, sample string, query_name string, file_order long, flag int").filter(is_usable(F.col("flag")))
    assert [r["file_order"] for r in R.dedupe_reads(df).collect()] == [1]


def test_cigar_predicates(spark):
    got = spark.createDataFrame([("5S10M",), ("5S5H",), ("5M3S5M",), ("10M",)], "c string").select(C.fully_clipped(F.col("c")), C.clipped_in_the_middle(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, False), (False, True), (False, False)]


def test_snv_tensor_columns(spark):
    ref = spark.createDataFrame([("1", 0, "A" * 200)], "chrom string, block_start long, seq string")
    reads = spark.createDataFrame([read("N", "31M", start=85, seq="C" * 31), read("T", "31M", start=85, seq="G" * 31, flag=16, order=1)], READS)
    t = M.snv_tensors(spark.createDataFrame([("1", 100)], "chrom string, pos long"), reads, ref, 200).first()
    x = np.array(t["data"]).reshape(100, 70, 5)
    assert (x[0, :35, 0] == 35).all() and (x[0, 35:, 0] == 175).all() and (x[1:, :, 0] == 0).all()
    assert (x[:, :, 4] == 245).all() and (x[0, :35, 2] == 125).all() and (x[0, 35:, 2] == 250).all()


def test_indel_layout():
    r = {"flag_reverse": False, "mapq": 60, "seq": "A" * 77, "quals": [30] * 77, "cigar": "27M2I48M", "ref_start": 64, "ref_end": 139}
    assert M.insertions(M.Read(r, 45), 64, 139) == {90: 2}
    clipped = M.Read(r | {"cigar": "5H3S10M2I10M", "seq": "A" * 25, "quals": [30] * 25}, 45)
    assert M.insertions(clipped, 64, 139) == {81: 2} and M.insertions(clipped, 64, 139, strict=True) == {73: 2}  # clips move the position
    start, colours, _ = M.indel_read(M.Read(r, 45), 64, 139, {90: 2, 110: 3}, 2, 75)
    assert start == 0 and len(colours) == 75 and colours[25:27] == [130, 130] and colours[47:50] == [0, 0, 0]
    image = M.indel_image({"chrom": "1", "pos": 100, "start": 64, "ref": "A" * 75, "normal": None, "tumor": [r]})
    assert image.shape == (140, 150, 5) and image[0, 0, 4] == 250 and image[1].sum() == 0


def test_network_shapes():
    assert S.shapes()[-6:] == [(7, 60, 32), (13440,), (256,), (128,), (64,), (1,)]
    net, x = S.Network.seeded(1), np.random.default_rng(0).random((2, 100, 70, 5), dtype="f4")
    y = net(x)
    assert y.shape == (2,) and ((y > 0) & (y < 1)).all() and S.adapted(net, x)(x).shape == (2,)


def test_chunking_does_not_matter(spark):
    reads = spark.createDataFrame([read("N", "30M", order=i) for i in range(8)] + [read("T", "30M", order=20 + i, seq="ACGT" * 7 + "TT") for i in range(8)], READS)
    whole = {(r["chrom"], r["pos"]) for r in pipeline.snv_candidates(reads).collect()}
    halves = spark.createDataFrame([("1", 0, 128), ("1", 128, 1000)], "chrom string, start long, end long")
    assert whole and whole == {(r["chrom"], r["pos"]) for r in pipeline.snv_candidates(reads, regions=halves).collect()}
    with pytest.raises(ValueError):
        pipeline.modes(True, True)


def test_sam_bam_fasta_bed_vcf(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nx\t16\t1\t101\t40\t5M1I4M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\n")
    r = text.read_sam(spark, str(tmp_path / "a.sam"), "T").first()
    assert (r["ref_start"], r["ref_end"], r["quals"][:2], r["flag"]) == (100, 109, [40, 40], 16)
    body = struct.pack("<iiBBHHHiiii", 0, 100, 2, 40, 0, 3, 16, 10, -1, -1, 0) + b"x\0" + struct.pack("<3I", 5 << 4, 1 << 4 | 1, 4 << 4) + bytes(int("".join(format("=ACMGRSVTWYHKDBN".index(c), "x") for c in p), 16) for p in ("AC", "GT", "AC", "GT", "AC")) + bytes([40] * 10)
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 500) + struct.pack("<i", len(body)) + body
    z = zlib.compressobj(wbits=-15)
    data = z.compress(raw) + z.flush()
    head = b"\x1f\x8b\x08\4" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25)
    (tmp_path / "a.bam").write_bytes(head + data + struct.pack("<II", zlib.crc32(raw), len(raw)))
    bam.register(spark)
    b = spark.read.format("bam").option("sample", "T").load(str(tmp_path / "a.bam")).first()
    assert {k: b[k] for k in b.asDict() if k != "file_order"} == {k: r[k] for k in r.asDict() if k != "file_order"}
    (tmp_path / "a.fa").write_text(">1 one\nACGTAC\nGT\n>2\nTTT\n")
    fa = text.read_fasta(spark, str(tmp_path / "a.fa"), 4)
    assert sorted(map(tuple, fa.collect())) == [("1", 0, "ACGT"), ("1", 4, "ACGT"), ("2", 0, "TTT")]
    assert I.with_reference(spark.createDataFrame([("1", 2)], "chrom string, pos long"), fa, F.lit(4), 4).first()["ref"] == "GTAC"
    (tmp_path / "a.bed").write_text("1\t5\t9\n2\t0\t3\textra\n")
    assert [tuple(x)[1:] for x in text.read_bed(spark, str(tmp_path / "a.bed")).orderBy("idx").collect()] == [("1", 5, 9), ("2", 0, 3)]
    rows = spark.createDataFrame([("1", 11, ".", "A", "C", ".", "PASS", "x;", "GT", "0/1")], "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, format string, sample string")
    text.write_vcf(rows, str(tmp_path / "v"), "s1", reference="a.fa", normal="n.bam", tumor="t.bam")
    lines = next((tmp_path / "v").glob("part-*")).read_text().splitlines()
    assert {"##reference=a.fa", "##normalBAM=n.bam", "##tumorBAM=t.bam"} <= set(lines) and any(x.startswith("##source=pilefold") for x in lines)
    assert lines[0].startswith("##fileformat") and lines[-1] == "1\t11\t.\tA\tC\t.\tPASS\tx;\tGT\t0/1" and lines[-2].startswith("#CHROM")


def test_end_to_end_calls(spark):
    ref = spark.createDataFrame([("1", 0, "ACGT" * 100)], "chrom string, block_start long, seq string")
    reads = spark.createDataFrame([read("N", "40M", order=i) for i in range(10)] + [read("T", "40M", order=20 + i, seq=("ACGT" * 10)[:20] + ("G" if i < 6 else "A") + ("ACGT" * 10)[21:]) for i in range(10)], READS)
    c = pipeline.snv_candidates(reads)
    assert [tuple(r) for r in c.collect()] == [("1", 120)]
    p = pipeline.predict(c, reads, ref, 400, "snv", S.Network.seeded(0)).withColumn("pred_true", F.lit(0.9))
    got = pipeline.call(p, None, reads, ref, 400).collect()
    assert [(r["pos"], r["ref"], r["alt"], r["filter"]) for r in got] == [(121, "A", "G", "PASS")]


def test_streaming_coverage(spark, tmp_path):
    from pilefold.streaming.coverage import start, streaming_coverage

    spark.createDataFrame([read("N", "10M")], READS).write.parquet(str(tmp_path / "in"))
    q = start(streaming_coverage(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("depth")).first()[0] == 10


@pytest.mark.parametrize("left, right, want", [
    ("", "AAAAC", (1, 5.0)), ("G", "ATATAT", (2, 3.0)), ("AGCAGCA", "C", (3, 7 / 3)), ("AA", "AAA", (1, 5.0)), ("C", "ACGT", (1, 2.0)), ("TATA", "ATAT", (2, 4.0)), ("", "", (1, 2.0)),
])
def test_tandem_repeats(spark, left, right, want):
    got = spark.createDataFrame([(left, right)], "l string, r string").select(E.tandem_repeat(F.col("l"), F.col("r")).alias("x")).first()["x"]
    assert (got["size"], round(got["repeats"], 9)) == (want[0], round(want[1], 9))


def test_tandem_repeats_take_each_side_once(spark):
    """One pass over both sides, however often size and repeats are named; a letter at a time gives the same."""

    def plain(s):
        unit, run, size, repeats = 1, 0, 1, 1.0
        for at in range(1, len(s) + 1):
            if at < len(s) and s[at] == s[run % unit]:
                run += 1
                continue
            if run:
                size, repeats = unit, run / unit + 1
            unit, run = at + 1, 0
        return size, repeats

    seqs = ["".join(x) for n in range(7) for x in itertools.product("AC\U0001f9ec", repeat=n)] + ["ACG" * 40 + "T", "A" * 300]
    df = spark.createDataFrame([(s, s[::-1]) for s in seqs] + [(None, None)], "l string, r string").withColumn("x", E.tandem_repeat(F.col("l"), F.col("r")))
    got = df.select("r", "x.size", "x.repeats").collect()
    assert all((r["size"], r["repeats"]) == (s, 2 * n) for r in got for s, n in [plain(r["r"] or "")])
    assert "aggregate(" not in df.select("x.size", "x.repeats")._jdf.queryExecution().optimizedPlan().toString()


def test_clip_proximity(spark):
    rows = [(None, None, 20, 2), (40, None, 20, 2), (0, 5, 20, 2), (40, 5, 20, 2), (21, 19, 20, 2)]
    got = spark.createDataFrame(rows, "e int, s int, a int, n int").select(E.clip_proximity(F.col("e"), F.col("s"), F.col("a"), F.col("n"), F.lit(99)).alias("d")).collect()
    assert [r["d"] for r in got] == [99, 18, 15, 15, -1]


def test_read_totals_and_coverage(spark):
    reads = spark.createDataFrame([read("T", "10M"), read("T", "2S4M2I4M", order=1), read("T", "4M3D6M", flag=0x400, order=2), read("T", "4M1D2M", mapq=5, order=3)], READS)
    got = {r["pos"]: r["reads"] for r in P.read_totals(spark.createDataFrame([("1", 100), ("1", 109), ("1", 300)], "chrom string, pos long"), reads).collect()}
    assert got == {100: 3, 109: 1, 300: 0}
    got = {r["pos"]: r["coverage"] for r in N.indel_read_coverage(reads).collect()}
    assert got == {100: 1, 101: 1, 102: 2, 103: 2, 104: 2, 105: 2, 106: 3, 107: 1, 108: 1, 109: 1}  # the leading clip shifts by two
    stats = V.true_indel_stats(reads, spark.createDataFrame([("1", 104), ("1", 106)], "chrom string, pos long")).orderBy("pos").collect()
    assert [tuple(r) for r in stats] == [("1", 104, 0, 1, 5, 5), ("1", 106, 1, 1, 40, 40)]


def test_tables_round_trip(spark, tmp_path):
    sites = spark.createDataFrame([("1", 5), ("X", 7)], "chrom string, pos long")
    text.write_tsv(sites, str(tmp_path / "c"), single=True)
    assert sorted(map(tuple, text.read_candidates(spark, str(tmp_path / "c")).collect())) == [("1", 5), ("X", 7)]
    text.write_tsv(sites.withColumn("p", F.lit(0.25)), str(tmp_path / "p"))
    assert sorted(map(tuple, text.read_predictions(spark, str(tmp_path / "p")).collect())) == [("1", 5, 0.25), ("X", 7, 0.25)]
    (tmp_path / "t.tsv").write_text("CHROM\tPOS\tLABEL\n1\t6\t1\nX\t8\t0\n")
    assert sorted(map(tuple, text.read_truth(spark, str(tmp_path / "t.tsv"), header=True, label=2).collect())) == [("1", 5, 1.0), ("X", 7, 0.0)]
    (tmp_path / "s.txt").write_text("1/6/1\n\nX/8/0\n")
    assert sorted(map(tuple, text.read_set_items(spark, str(tmp_path / "s.txt")).collect())) == [("1", 5, 1.0), ("X", 7, 0.0)]
    names = spark.createDataFrame([("a", "a-N.bam"), ("a", "a-T.bam"), ("b", "b_normal.bam"), ("c", "c-N.bam"), ("c", "c-N2.bam"), ("c", "c-T.bam")], "patient string, name string")
    assert [tuple(r) for r in text.pair_samples(names).collect()] == [("a", "a-N.bam", "a-T.bam")]
    assert [tuple(r) for r in R.sharded(names, "patient", 2).groupBy("shard").count().orderBy("shard").collect()] == [(0, 3), (1, 3)]
