"""Images of many sites at once against those of one, and what is exchanged for them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pilefold.config import IndelTensor, SnvTensor
from pilefold.operators import images as B
from pilefold.operators import tensors as M

READ = pa.struct([("file_order", pa.int64()), ("flag_reverse", pa.bool_()), ("mapq", pa.int32()), ("seq", pa.string()), ("quals", pa.list_(pa.int16())), ("ref_start", pa.int64()), ("ref_end", pa.int64()), ("cigar", pa.string())])
SHARE = pa.struct([("at", pa.int64()), *[(b, pa.float32()) for b in "ACGT"]])
SITE = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("start", pa.int64()), ("ref", pa.string()), ("normal", pa.list_(READ)), ("tumor", pa.list_(READ)), *[(f"{s}_fractions", pa.list_(SHARE)) for s in ("normal", "tumor")], ("variant", pa.string()), ("share", pa.float64())])


def _sites(rng, n, before, length, most=9):
    def read(i, pos):
        cigar = "".join(rng.choice(["40M", "9M2I8M", "9M3D8M1I2D7M", "4S20M3S", "3S5M2I5M", "2I9M", "5M4S2I6M", "3H12M1I4M", "6M2P1I8M", "7M5N9M", "2D9M", "30M2D", "12M6I", "5S"]) for _ in range(1))
        size = sum(k for op, k in M.operations(cigar) if op in "MIS")
        quals = None if rng.random() < 0.1 else [rng.randrange(60) for _ in range(size)]
        start = max(0, pos + rng.randrange(-50, 50))
        return {"file_order": i, "flag_reverse": rng.random() < 0.5, "mapq": rng.choice([0, 13, 60, 255]), "seq": "".join(rng.choice("ACGTN") for _ in range(size)), "quals": quals, "ref_start": start, "ref_end": start + 9, "cigar": cigar}

    out = []
    for _ in range(n):
        pos = rng.choice([3, 20, 1000, 5000])
        start = max(0, pos - before)
        reads = lambda: rng.choice([None, [read(i, pos) for i in range(rng.randrange(most))]])
        shares = lambda: [{"at": pos - 15 + i, **{b: rng.random() for b in "ACGT"}} for i in range(31) if rng.random() < 0.5]
        out.append({"chrom": "1", "pos": pos, "start": start, "ref": "".join(rng.choice("ACGTN") for _ in range(pos + length - before - start)), "normal": reads(), "tumor": reads(), "normal_fractions": shares(), "tumor_fractions": None, "variant": rng.choice(["A", "T", None]), "share": rng.choice([0.0, 0.5, 0.9, None])})
    return pa.RecordBatch.from_pylist(out, schema=SITE)


@pytest.mark.parametrize("cfg", [SnvTensor(), SnvTensor(rows=4), SnvTensor(rows=3, falling=True, allele_fractions=True), IndelTensor(), IndelTensor(rows=5), IndelTensor(strict_positions=True)])
def test_images_at_once(cfg):
    snv = isinstance(cfg, SnvTensor)
    batch = _sites(random.Random(5), 150, cfg.flank if snv else cfg.before, 2 * cfg.flank + 1 if snv else cfg.length).slice(7)
    many, one = (B.snv_images, M.snv_image) if snv else (B.indel_images, M.indel_image)
    got, kept = many(batch, cfg), 0
    for image, site in zip(got, batch.to_pylist()):
        np.testing.assert_array_equal(image, one(site, cfg))
        kept += image[..., :4].any()
    assert kept > 50


@pytest.mark.parametrize("make", ["snv", "indel", "fallen", "spiked"])
def test_reads_are_exchanged_once(spark, make):
    """Neither a site's reads nor its image is moved by another exchange or sort after they are collected."""
    from pilefold.plans import pipeline as P

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reads = spark.createDataFrame([("T", i, f"r{i}", 0, "1", 1000 + i, 1010 + i, 60, "10M", "ACGTACGTAC", [30] * 10) for i in range(40)], "sample string, file_order long, query_name string, flag int, chrom string, ref_start long, ref_end long, mapq int, cigar string, seq string, quals array<int>")
        sites = spark.createDataFrame([("1", 1020, "A", 1.0), ("1", 1030, "C", 0.0), ("1", 9000, "C", 0.0)], "chrom string, pos long, variant string, label double")
        reference = spark.createDataFrame([("1", 64 * i, "ACGT" * 16) for i in range(40)], "chrom string, block_start long, seq string")
        if make == "indel":
            out = M.indel_tensors(sites, reads, reference, 64, keep=("label",))
        else:
            cfg = SnvTensor(rows=4, falling=True, allele_fractions=True) if make == "fallen" else SnvTensor()
            out = P.snv_images(sites, reads, reference, 64, cfg, spike=make == "spiked", keep=("label",))
        assert sorted((r["pos"], r["label"], len(r["data"]) > 0) for r in out.collect()) == [(1020, 1.0, True), (1030, 0.0, True), (9000, 0.0, True)]
        plan = out._jdf.queryExecution().executedPlan().toString()
        plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
        moved = [line for line in plan.splitlines() if ("Exchange" in line or " Sort " in line) and ("normal#" in line or "tumor#" in line)]
        assert not moved
        above = plan[: plan.index("SortMergeJoin")]
        assert "collect_list" in above and "Exchange" not in [line for line in above.splitlines() if "_fs" not in line and "_f#" not in line][-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_reads_from_anywhere_are_put_in_order(spark):
    """Batches of reads from anywhere leave some rows a position, not one a base."""
    from pilefold.operators import sweep as W

    places = [(i * 7919) % 4000 for i in range(4000)]
    reads = spark.createDataFrame([("NT"[i % 2], "1", p, "20M", "ACGTACGTACACGTACGTAC", [30] * 20) for i, p in enumerate(places)], "sample string, chrom string, ref_start long, cigar string, seq string, quals array<int>").repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        anywhere, ordered = W.partial_counts(reads, 22), W.partial_counts(W.in_place(reads), 22)
        assert anywhere.count() > 4 * ordered.count()
        got = {(r["sample"], r["pos"]): r["depth"] for r in W.coverage_sweep(reads).collect()}
        assert got == {(r["sample"], r["pos"]): r["depth"] for r in W.coverage_sweep(reads, in_order=True).collect()} and sum(got.values()) == 80_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_fallen_reads_of_deep_sites(spark):
    """Only reads that show are kept where there are more than fit, and their images stay as all reads give them."""
    from pilefold.operators.rows import reaching

    rng = random.Random(3)
    rows = [("1", "T", i, s, s + 10, 0, 31) for i in range(400) for s in [rng.randrange(-9, 31)]] + [("2", "T", i, 0, 5, 0, 31) for i in range(20)]
    df = spark.createDataFrame(rows, "site string, sample string, file_order long, ref_start long, ref_end long, w_start long, w_end long")
    got = sorted(r["file_order"] for r in reaching(df.repartition(3), ["site", "sample"], 2).filter("site = '1'").collect())
    depth, want = np.zeros(31, int), []
    for _, _, i, s, e, _, _ in rows[:400]:
        if (depth[max(s, 0) : e] < 2).any():
            want.append(i)
        depth[max(s, 0) : e] += 1
    assert got == want and len(want) <= 62
    assert reaching(df, ["site", "sample"], 2).filter("site = '2'").count() == 2
    assert "Generate" not in reaching(df, ["site", "sample"], 2)._jdf.queryExecution().executedPlan().toString()


def test_colour_totals(spark):
    """Totals of a batch at a time against a row for each column."""
    from pyspark.sql import functions as F

    from pilefold.functions import cigar as C
    from pilefold.functions import encode as E

    rng = random.Random(9)
    rows = [(rng.randrange(1 << 31), rng.choice(["4S6M2D3M3S", "3M2I4M", "2M3S4M", "5N3M", "3H2M1P4=", "9S", None]), rng.choice([None, "ACGTNacgtACG", "GG"])) for _ in range(200)]
    reads = spark.createDataFrame(rows, "ref_start long, cigar string, seq string")
    pairs = reads.select("seq", F.explode(C.trimmed_pairs(F.col("ref_start"), F.col("cigar"))).alias("p"))
    letter = F.substring("seq", (F.col("p.rp") + 1).cast("int"), F.lit(1))
    want = pairs.groupBy(F.col("p.op").alias("op"), E.match_value(F.col("p.op"), letter).alias("value")).agg(F.count("*").alias("n"), F.sum("p.rp").alias("read_sum"), F.sum("p.gp").alias("ref_sum"))
    assert sorted(map(tuple, B.colour_totals(reads).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_indel_stats_pass_over_the_evidence_once(spark):
    from pilefold.operators import calls as K

    item = "struct<kind:string,seq:string,len:bigint>"
    rows = [("1", 5, 1, []), ("1", 5, 0, [("I", "A", 1)]), ("1", 5, 0, [("D", None, 1), ("I", "A", 1)]), ("1", 5, 1, [("D", None, 1)]), ("1", 9, 1, [])]
    out = K.indel_stats(spark.createDataFrame(rows, f"chrom string, pos long, ro int, items array<{item}>"))
    assert sorted((r["pos"], r["dp"], r["ro"], r["ao"], r["kind"], r["seq"], r["len"]) for r in out.collect()) == [(5, 4, 2, 2, "D", None, 1), (9, 1, 1, 0, None, None, None)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_shares_come_with_the_reads(spark):
    """Bases are counted where reads meet their sites: reads are taken and exchanged for it once, and no read is moved between the count and the choice of reads."""
    from pilefold.plans import pipeline as P

    reads = spark.createDataFrame([("T", 1, "r", 0, "1", 1000, 1010, 60, "10M", "ACGTACGTAC", [30] * 10)], "sample string, file_order long, query_name string, flag int, chrom string, ref_start long, ref_end long, mapq int, cigar string, seq string, quals array<int>")
    sites = spark.createDataFrame([("1", 1005)], "chrom string, pos long")
    reference = spark.createDataFrame([("1", 960, "ACGT" * 16)], "chrom string, block_start long, seq string")
    for falling in (True, False):
        plan = P.snv_images(sites, reads, reference, 64, SnvTensor(rows=4, falling=falling, allele_fractions=True))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ExistingRDD[sample#") == 1
        assert plan[: plan.index("SortMergeJoin")].count("Exchange ") == 1  # to the collecting of a site's reads


@pytest.mark.parametrize("falling", [True, False])
def test_shares_by_hand(spark, falling):
    """Shares are of all reads of the default pileup, drawn or not, with names twice and supplementary ones; rows are of usable first records."""
    from pilefold.plans import pipeline as P

    rng = random.Random(4)
    rows = []
    for i in range(300):
        a, n, flag = rng.randrange(0, 40), rng.randrange(5, 15), rng.choice([0, 0, 16, 0x800, 0x200, 0x100, 0x400, 4])
        quals = rng.choice([None, [rng.randrange(5, 40) for _ in range(n)]])
        rows.append((rng.choice("NT"), i, rng.choice([None, *(f"r{k}" for k in range(60))]), flag, "1", a, a + n, 60, f"{n}M", "".join(rng.choice("ACGTNacgt") for _ in range(n)), quals))
    rows += [("T", 300, "s", 0x800, "1", 700, 710, 60, "10M", "ACGTACGTAC", None), ("N", 301, "q", 0x200, "1", 900, 910, 60, "10M", "ACGTACGTAC", None)]
    reads = spark.createDataFrame(rows, "sample string, file_order long, query_name string, flag int, chrom string, ref_start long, ref_end long, mapq int, cigar string, seq string, quals array<int>")
    reference = spark.createDataFrame([("1", 64 * i, "ACGT" * 16) for i in range(20)], "chrom string, block_start long, seq string")
    sites = spark.createDataFrame([("1", p) for p in (3, 20, 33, 705, 905, 1100)], "chrom string, pos long")
    cfg, width = SnvTensor(flank=8, repeats=1, rows=6, falling=falling, allele_fractions=True), 17
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [(r["pos"], np.array(r["data"], "f4").reshape(cfg.shape)) for r in P.snv_images(sites, reads, reference, 64, cfg, replicates=1 if falling else 3).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(p for p, _ in got) == sorted(p for p in (3, 20, 33, 705, 905, 1100) for _ in range(1 if falling else 3))
    for pos, image in got:
        for h, sample in enumerate("NT"):
            counts, names, shown = np.zeros((width, 4)), set(), np.zeros(width, int)
            for s, _, name, flag, _, a, b, _, _, seq, quals in rows:
                inside = [k for k in range(b - a) if pos - 8 <= a + k <= pos + 8]
                if s != sample or not inside:
                    continue
                if not flag & 0x704:
                    for k in inside:
                        if seq[k] != "N" and (quals is None or quals[k] >= 15):
                            counts[a + k - pos + 8, "ATGC".index(seq[k].upper())] += 1
                if not flag & 0xD04 and name not in names:
                    names.add(name)
                    shown[[a + k - pos + 8 for k in inside]] += 1
            half = image[:, h * width : (h + 1) * width]
            shares = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype("f4")
            np.testing.assert_array_equal(half[..., 4:8], np.broadcast_to(shares, (6, width, 4)))
            if falling:
                np.testing.assert_array_equal((half[..., 2] > 0).sum(axis=0), np.minimum(shown, 6))
            else:
                assert (half[..., 2] > 0).any(axis=1).sum() == min(len(names), 6)
