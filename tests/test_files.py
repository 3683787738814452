"""Sources read by splits, and the way from files to calls."""

import random
import struct
import zlib

import numpy as np
import pytest

from pilefold import __main__ as command
from pilefold import config
from pilefold.operators import scoring as S
from pilefold.plans import queries
from pilefold.sources import bam, text

CODES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(wbits=-15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\4" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(ref, pos, name, flag, cigar, seq, qual=40, mapq=60) -> bytes:
    ops = [(n, op) for n, op in cigar]
    codes = [CODES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes([qual] * len(seq))
    return struct.pack("<i", len(body)) + body


def write_bam(path, contigs, rows, per_block=3) -> None:
    """A sorted BAM of (ref, pos, name, flag, cigar, seq) with an index; a record may begin in one block and end in the next."""
    out = packed(b"BAM\1" + struct.pack("<ii", 0, len(contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs))
    chunks, windows = {r: [] for r in range(len(contigs))}, {r: {} for r in range(len(contigs))}
    left = b""
    for at in range(0, len(rows), per_block):
        block, begins = left, []
        for row in rows[at : at + per_block]:
            begins.append((row, len(out) << 16 | len(block)))
            block += record(*row)
        left = block[-5:] if at + per_block < len(rows) else b""
        out += packed(block[: len(block) - len(left)])
        for (ref, pos, *_), place in begins:
            chunks[ref].append(place)
            windows[ref].setdefault(pos >> 14, place)
    end = len(out) << 16
    out += packed(b"")
    path.write_bytes(out)
    index = b"BAI\1" + struct.pack("<i", len(contigs))
    for r in chunks:
        later = [c[0] for q, c in chunks.items() if q > r and c]
        index += struct.pack("<i", bool(chunks[r])) + (struct.pack("<IiQQ", 0, 1, chunks[r][0], later[0] if later else end) if chunks[r] else b"")
        n = max(windows[r], default=-1) + 1
        index += struct.pack("<i", n) + b"".join(struct.pack("<Q", windows[r].get(w, 0)) for w in range(n))
    path.with_name(path.name + ".bai").write_bytes(index)


def test_bam_by_splits(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((rng.randrange(2), rng.randrange(90_000), f"r{i}", 0, [(10, "M")], "".join(rng.choice("ACGT") for _ in range(10))) for i in range(60))
    write_bam(tmp_path / "a.bam", [("1", 100_000), ("2", 100_000), ("3", 100)], rows)
    bam.register(spark)
    load = lambda size: spark.read.format("bam").option("splitBytes", size).load(str(tmp_path / "a.bam"))
    whole, cut = load(1 << 30), load(200)
    assert cut.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
    assert sorted(cut.collect()) == sorted(whole.collect())
    assert [r["query_name"] for r in cut.orderBy("file_order").collect()] == [r[2] for r in rows]
    for df in (whole, cut):
        some = df.filter("chrom = '2' and ref_start < 50000 and ref_end > 30000").select("query_name")
        assert sorted(r[0] for r in some.collect()) == sorted(r[2] for r in rows if r[0] == 1 and r[1] < 50_000 and r[1] + 10 > 30_000)
        assert df.filter("chrom = '3'").count() == df.filter("chrom = 'x'").count() == 0


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_fasta_by_splits(spark, tmp_path, split):
    rng = random.Random(split)
    want = {"1": 500, "2": 7, "none": 0, "3": 64, "4": 1}
    want = {k: "".join(rng.choice("acgtN") for _ in range(n)) for k, n in want.items()}
    (tmp_path / "a.fa").write_text("".join(f">{k} text\n" + "".join(s[i : i + 30] + "\n" for i in range(0, len(s), 30)) + "\n" for k, s in want.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    got = {}
    for r in text.read_fasta(spark, str(tmp_path / "a.fa"), 16).orderBy("chrom", "block_start").collect():
        assert r["block_start"] == len(got.get(r["chrom"], "")) and len(r["seq"]) <= 16
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: s for k, s in want.items() if s}


def sure(shape) -> S.Network:
    """A network that gives every site 0.99."""
    network = S.Network.seeded(0, shape=shape)
    network.weights[-1]["w"][:], network.weights[-1]["b"][:] = 0, 5
    return network


def test_from_files_to_calls(spark, tmp_path, monkeypatch):
    ref = "ACGT" * 100
    (tmp_path / "r.fa").write_text(">1\n" + ref + "\n")
    changed = ref[100:120] + "G" + ref[121:140]
    normal = [(0, 100, f"n{i}", 0, [(40, "M")], ref[100:140]) for i in range(10)] + [(0, 200, f"m{i}", 0, [(40, "M")], ref[200:240]) for i in range(10)]
    tumor = [(0, 100, f"t{i}", 0, [(40, "M")], changed if i < 6 else ref[100:140]) for i in range(10)]
    tumor += [(0, 200, f"u{i}", 0, [(20, "M"), (2, "D"), (20, "M")], ref[200:220] + ref[222:242]) for i in range(8)]
    write_bam(tmp_path / "n.bam", [("1", 400)], normal)
    write_bam(tmp_path / "t.bam", [("1", 400)], tumor)
    out = tmp_path / "out"
    args = ["--sample_name", "s", "--normal_bam", str(tmp_path / "n.bam"), "--tumor_bam", str(tmp_path / "t.bam"), "--output_dir", str(out), "--reference", str(tmp_path / "r.fa")]
    command.main(["filter", *args])
    assert sorted(map(tuple, text.read_candidates(spark, str(out / "s/snv.candidates")).collect())) == [("1", 120)]
    assert sorted(map(tuple, text.read_candidates(spark, str(out / "s/indel.candidates")).collect())) == [("1", 219)]
    scorers = {"snv": sure((100, 70, 5)), "indel": sure((140, 150, 5))}
    command.main(["predict", *args], scorers=scorers)

    def calls():
        lines = next((out / "s/s.vcf").glob("part-*")).read_text().splitlines()
        return [x.split("\t")[:5] for x in lines if not x.startswith("#")]

    want = [["1", "121", ".", "A", "G"], ["1", "220", ".", "TAC", "T"]]
    assert calls() == want
    monkeypatch.setattr(command.P, "predict", None)  # a second run predicts nothing again
    command.main(["predict", *args], scorers=scorers)
    assert calls() == want


def test_training_files_and_settings_by_command(spark, tmp_path):
    """Labelled sites to .npz files: all positives, as many negatives, and a site with a variant put in; a second run changes nothing."""
    ref = "ACGT" * 100
    (tmp_path / "r.fa").write_text(">1\n" + ref + "\n")
    rows = [(0, 100 + 40 * k, f"n{k}_{i}", 0, [(40, "M")], ref[:40]) for k in range(5) for i in range(10)]
    write_bam(tmp_path / "n.bam", [("1", 400)], rows)
    write_bam(tmp_path / "t.bam", [("1", 400)], rows)
    (tmp_path / "labels.tsv").write_text("1\t121\t1\n" + "".join(f"1\t{161 + 40 * k}\t0\n" for k in range(4)))
    (tmp_path / "spikes.tsv").write_text("1\t241\tC\n")
    (tmp_path / "s.json").write_text('{"SnvTensor": {"rows": 20, "falling": true, "allele_fractions": true}}')
    args = ["train", "--sample_name", "s", "--normal_bam", str(tmp_path / "n.bam"), "--tumor_bam", str(tmp_path / "t.bam"), "--output_dir", str(tmp_path / "out"), "--reference", str(tmp_path / "r.fa")]
    args += ["-snv", "--labels", str(tmp_path / "labels.tsv"), "--spikes", str(tmp_path / "spikes.tsv"), "--settings", str(tmp_path / "s.json")]
    command.main(args)
    files = sorted((tmp_path / "out/s/snv.training").glob("*.npz"))
    held = [(int(p), float(y), x) for f in files for z in [np.load(f)] for p, x, y in zip(z["pos"], z["X"], z["Y"])]
    assert all(x.shape == (20, 70, 9) for _, _, x in held)
    assert (120, 1.0) in [h[:2] for h in held] and sorted(y for _, y, _ in held) == [0.0, 1.0, 1.0]
    spiked = next(x for p, y, x in held if (p, y) == (240, 1.0))
    letters = spiked[:10, 35 + 15, 0].tolist()
    assert ref[240] == "A" and set(letters) <= {245.0, 35.0} and letters == sorted(letters, reverse=True) and letters.count(35.0) == round(np.random.default_rng([0, 240]).beta(2, 5) * 10)
    command.main(args)
    assert sorted((tmp_path / "out/s/snv.training").glob("*.npz")) == files
    for wrong in ('{"Nothing": {}}', '{"SnvTensor": {"x": 1}}'):
        (tmp_path / "s.json").write_text(wrong)
        with pytest.raises((ValueError, TypeError)):
            command.main(args)


def test_network_from_files(tmp_path):
    network = S.Network.seeded(1)
    S.save_weights(network, str(tmp_path / "w.npz"))
    np.save(tmp_path / "m.npy", np.arange(5.0))
    np.save(tmp_path / "s.npy", np.full(5, 2.0))
    x = np.random.default_rng(0).normal(size=(2, 100, 70, 5)).astype("f4")
    assert np.allclose(S.load_network(str(tmp_path / "w.npz"))(x), network(x))
    held = S.load_network(str(tmp_path / "w.npz"), None, str(tmp_path / "m.npy"), str(tmp_path / "s.npy"))
    assert np.allclose(held(x), network((x - np.arange(5)) / 2))


def test_parameters_as_json(tmp_path):
    (tmp_path / "c.json").write_text('{"min_mapq": 20}')
    cfg = config.load(config.SnvFilter, str(tmp_path / "c.json"))
    assert cfg == config.SnvFilter(min_mapq=20) and '"min_mapq": 20' in config.as_json(cfg)
    (tmp_path / "c.json").write_text('{"nothing": 1}')
    with pytest.raises(TypeError):
        config.load(config.SnvFilter, str(tmp_path / "c.json"))


@pytest.mark.parametrize("name", ["snv_tensors", "indel_tensors", "fallen_tensors", "spiked_tensors", "scored_sites", "scored_indels", "indel_site_stats", "tandem_repeats"])
def test_images_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
