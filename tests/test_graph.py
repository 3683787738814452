"""Networks as graphs: against direct loops, refusal of what isn't known, batch-norm moments, entropy minimisation, replicates."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


from pilefold import __main__ as command
from pilefold.operators import graph as G
from pilefold.operators import scoring as S
from pilefold.operators.rows import sample_replicates
from pilefold.plans import pipeline as P


def layer(kind, name, inputs=None, **c):
    return {"class_name": kind, "name": name, "config": {"name": name, **c}, "inbound_nodes": [[[i, 0, 0, {}] for i in inputs]] if inputs else []}


BRANCHED = json.dumps({
    "class_name": "Functional",
    "config": {
        "layers": [
            layer("Dense", "out", ["flat"], units=1, activation="sigmoid"),  # files need not be in order
            layer("InputLayer", "in"), layer("Conv2D", "a", ["in"], filters=3, kernel_size=[3, 2], strides=[2, 1], padding="same", activation="relu"),
            layer("Conv2D", "b", ["in"], filters=3, kernel_size=[2, 3], strides=[2, 1], padding="same", use_bias=False), layer("BatchNormalization", "bn", ["b"], epsilon=0.01, scale=False),
            layer("Activation", "act", ["bn"], activation="tanh"), layer("Add", "sum", ["a", "act"]), layer("MaxPooling2D", "top", ["sum"], pool_size=[2, 2], strides=[1, 2], padding="same"),
            layer("AveragePooling2D", "mean", ["sum"], pool_size=[3, 2], strides=[1, 2], padding="same"), layer("Concatenate", "both", ["top", "mean"], axis=-1), layer("ZeroPadding2D", "wide", ["both"], padding=[[0, 1], [1, 0]]),
            layer("Dropout", "drop", ["wide"], rate=0.5), layer("BatchNormalization", "bn2", ["drop"]), layer("Flatten", "flat", ["bn2"]),
        ],
        "input_layers": [["in", 0, 0]], "output_layers": [["out", 0, 0]],
    },
})
SHAPE = (7, 5, 2)


def same(x, k, s, fill):
    """x of one site with margins, cell by cell."""
    need = [max((-(-n // t) - 1) * t + m - n, 0) for n, m, t in zip(x.shape, k, s)]
    out = np.full((x.shape[0] + need[0], x.shape[1] + need[1], x.shape[2]), fill)
    out[need[0] // 2 : need[0] // 2 + x.shape[0], need[1] // 2 : need[1] // 2 + x.shape[1]] = x
    return out


def windows(x, k, s, f):
    rows, cols = ((n - m) // t + 1 for n, m, t in zip(x.shape, k, s))
    return np.array([[f(x[r * s[0] : r * s[0] + k[0], c * s[1] : c * s[1] + k[1]]) for c in range(cols)] for r in range(rows)])


def by_loops(net, x):
    w = {k: [a.astype("f8") for a in v] for k, v in net.weights.items()}
    a = windows(same(x, (3, 2), (2, 1), 0.0), (3, 2), (2, 1), lambda p: np.maximum(np.einsum("ijc,ijcf->f", p, w["a"][0]) + w["a"][1], 0))
    b = windows(same(x, (2, 3), (2, 1), 0.0), (2, 3), (2, 1), lambda p: np.einsum("ijc,ijcf->f", p, w["b"][0]))
    both = a + np.tanh((b - w["bn"][1]) / np.sqrt(w["bn"][2] + 0.01) + w["bn"][0])
    top = windows(same(both, (2, 2), (1, 2), -np.inf), (2, 2), (1, 2), lambda p: p.max((0, 1)))
    mean = windows(same(both, (3, 2), (1, 2), np.nan), (3, 2), (1, 2), lambda p: np.nanmean(p, (0, 1)))
    y = np.pad(np.concatenate([top, mean], -1), ((0, 1), (1, 0), (0, 0)))
    y = w["bn2"][0] * (y - w["bn2"][2]) / np.sqrt(w["bn2"][3] + 0.001) + w["bn2"][1]
    return 1 / (1 + np.exp(-(y.ravel() @ w["out"][0] + w["out"][1])[0]))


@pytest.fixture(scope="module")
def net():
    return G.Graph.seeded(G.nodes_of(BRANCHED), SHAPE, 4)


def test_branches_against_loops(net, tmp_path):
    x = np.random.default_rng(0).normal(size=(5, *SHAPE))
    np.testing.assert_allclose(net(x), [by_loops(net, v) for v in x], rtol=2e-4)
    net.save(str(tmp_path / "w.npz"))
    (tmp_path / "a.json").write_text(BRANCHED)
    np.save(tmp_path / "m.npy", np.full(2, 0.5))
    np.save(tmp_path / "s.npy", np.full(2, 2.0))
    read = S.load_network(str(tmp_path / "w.npz"), str(tmp_path / "a.json"), str(tmp_path / "m.npy"), str(tmp_path / "s.npy"))
    np.testing.assert_allclose(read(x), net((x - 0.5) / 2), rtol=1e-5)


def test_newer_files_name_inputs_by_their_history():
    tensor = lambda n: {"class_name": "__keras_tensor__", "config": {"shape": [None, 4], "keras_history": [n, 0, 0]}}
    layers = [layer("InputLayer", "in"), layer("Dense", "d", units=2), layer("Concatenate", "c"), layer("Dense", "out", units=1)]
    layers[1]["inbound_nodes"] = [{"args": [tensor("in")], "kwargs": {}}]
    layers[2]["inbound_nodes"] = [{"args": [[tensor("in"), tensor("d")]], "kwargs": {}}]
    layers[3]["inbound_nodes"] = [{"args": [tensor("c")], "kwargs": {}}]
    nodes = G.nodes_of(json.dumps({"class_name": "Functional", "config": {"layers": layers, "input_layers": ["in", 0, 0], "output_layers": ["out", 0, 0]}}))
    assert [(n.name, n.inputs) for n in nodes] == [("in", ()), ("d", ("in",)), ("c", ("in", "d")), ("out", ("c",))]


def test_the_snv_network_as_a_file(tmp_path):
    """A sequential file with activations and norms as layers of their own computes what the fixed layers do, with the same weights."""
    layers, weights, fixed = [], {}, S.Network.seeded(3)
    rng = np.random.default_rng(2)
    for i, ((kind, size, n), w) in enumerate(zip(S.SNV_LAYERS, fixed.weights)):
        if w is not None:
            w.update(b=rng.normal(size=n).astype("f4"), mean=rng.normal(size=n).astype("f4"), var=rng.uniform(0.5, 2, n).astype("f4"), gamma=rng.uniform(0.5, 2, n).astype("f4"), beta=rng.normal(size=n).astype("f4"))
        if kind == "conv":
            layers.append(("Conv2D", {"name": f"l{i}", "filters": n, "kernel_size": list(size), "strides": [1, 1], "padding": "same" if size == (1, 1) else "valid", "dilation_rate": [1, 1], "data_format": "channels_last"}))
        elif kind == "dense":
            layers.append(("Dense", {"name": f"l{i}", "units": n}))
        else:
            layers.append(("AveragePooling2D", {"name": f"l{i}", "pool_size": list(size), "strides": list(size), "padding": "valid"}) if kind == "pool" else ("Flatten", {"name": f"l{i}"}))
        if w is not None:
            weights[f"l{i}"] = [w["w"], w["b"]]
            last = i == len(S.SNV_LAYERS) - 1
            layers.append(("Activation", {"name": f"a{i}", "activation": "sigmoid" if last else "relu"}))
            if not last:
                layers.append(("BatchNormalization", {"name": f"n{i}", "axis": -1, "epsilon": 0.001}))
                weights[f"n{i}"] = [w["gamma"], w["beta"], w["mean"], w["var"]]
    text = json.dumps({"class_name": "Sequential", "config": [{"class_name": k, "config": c} for k, c in layers]})
    x = rng.normal(size=(2, 100, 70, 5)).astype("f4")
    np.testing.assert_allclose(G.Graph(G.nodes_of(text), weights)(x), fixed(x), rtol=1e-3, atol=1e-5)


@pytest.mark.parametrize("bad", [
    layer("LSTM", "x", ["in"], units=3), layer("Conv2D", "x", ["in"], filters=1, kernel_size=[1, 1], dilation_rate=[2, 1]), layer("Conv2D", "x", ["in"], filters=1, kernel_size=[1, 1], data_format="channels_first"),
    layer("Dense", "x", ["in"], units=1, activation="swish"), layer("Concatenate", "x", ["in", "in"], axis=1), layer("ReLU", "x", ["in"], max_value=6.0), layer("Conv2D", "x", ["in"], filters=1, kernel_size=[1, 1], padding="causal"), layer("Flatten", "x", ["nowhere"]),
])
def test_refusal(bad):
    with pytest.raises(ValueError, match="known here|missing"):
        G.nodes_of(json.dumps({"class_name": "Model", "config": {"layers": [layer("InputLayer", "in"), bad], "input_layers": [["in", 0, 0]], "output_layers": [["x", 0, 0]]}}))


def test_weights_must_fit(net):
    with pytest.raises(ValueError, match="takes 2 arrays"):
        G.Graph(net.nodes, net.weights | {"a": net.weights["a"][:1]})
    with pytest.raises(ValueError, match="not there"):
        G.Graph(net.nodes, net.weights | {"zzz": []})


@pytest.fixture(scope="module")
def sites(spark):
    x = np.random.default_rng(5).normal(1, 2, (90, *SHAPE)).astype("f4")
    return x, spark.createDataFrame([("1", i, v.ravel().tolist()) for i, v in enumerate(x)], "chrom string, pos long, data array<float>").repartition(7)


def test_moments_layer_by_layer(net, sites):
    x, df = sites
    got = G.with_moments(net, df, SHAPE, batch=8)
    want = net
    for name in ("bn", "bn2"):
        seen = want.forward(x, until=name)[""].astype("f8")
        mean, var = seen.mean((0, 1, 2)), seen.var((0, 1, 2))
        np.testing.assert_allclose(got.weights[name][-2], mean, rtol=1e-4, atol=1e-6)
        np.testing.assert_allclose(got.weights[name][-1], var, rtol=1e-4)
        want = G.Graph(want.nodes, want.weights | {name: [*want.weights[name][:-2], mean.astype("f4"), var.astype("f4")]})
    few = G.with_moments(net, df, SHAPE, sites=10)
    assert not np.allclose(few.weights["bn"][-2], got.weights["bn"][-2]) and np.allclose(few.weights["bn"][-2], G.with_moments(net, df.coalesce(1), SHAPE, sites=10).weights["bn"][-2], atol=1e-6)
    assert G.with_moments(net, df.limit(0), SHAPE).weights["bn"][-2] is net.weights["bn"][-2]
    held = S.refreshed(S.Normalised(net, np.zeros(2), np.ones(2)), df, SHAPE)
    np.testing.assert_allclose(held.scorer.weights["bn2"][-1], got.weights["bn2"][-1], rtol=1e-4)
    with pytest.raises(ValueError):
        S.refreshed(S.Network.seeded(0), df, SHAPE)


def test_entropy_gradients_and_steps(net, sites):
    x, df = sites
    some = {k: [a.astype("f8") for a in v] for k, v in net.weights.items()}
    exact = G.Graph(net.nodes, some)
    value, n, grads = exact.entropy(x[:6].astype("f8"))
    p = exact.forward(x[:6].astype("f8"))["out"]
    assert n == 6 and np.isclose(value, -(p * np.log2(p) + (1 - p) * np.log2(1 - p)).sum())
    for name, arrays in grads.items():
        for i, g in enumerate(arrays):
            for at in range(len(g)):
                both = []
                for e in (1e-6, -1e-6):
                    moved = [a.copy() for a in some[name]]
                    moved[i][at] += e
                    both.append(G.Graph(net.nodes, some | {name: moved}).entropy(x[:6].astype("f8"))[0])
                assert np.isclose((both[0] - both[1]) / 2e-6, g[at], rtol=1e-3, atol=1e-5), (name, i, at)
    surer, seen = G.sharpened(net, df, SHAPE, steps=4)
    assert len(seen) == 5 and seen[-1] < seen[0] and all(a >= b for a, b in zip(seen, seen[1:]))
    assert all(np.array_equal(a, b) for k in ("a", "b", "out") for a, b in zip(surer.weights[k], net.weights[k]))


def test_pools_of_the_whole_and_max_gradients():
    nodes = G.nodes_of(json.dumps({"class_name": "Sequential", "config": {"layers": [{"class_name": k, "config": {"name": str(i), **c}} for i, (k, c) in enumerate([
        ("BatchNormalization", {}), ("MaxPooling2D", {"pool_size": 2}), ("ReLU", {}), ("GlobalAveragePooling2D", {}), ("Dense", {"units": 1, "activation": "sigmoid"})])]}}))
    net = G.Graph.seeded(nodes, (4, 4, 3), 1)
    exact = G.Graph(nodes, {k: [a.astype("f8") for a in v] for k, v in net.weights.items()})
    x = np.random.default_rng(1).normal(size=(5, 4, 4, 3))
    _, _, grads = exact.entropy(x)
    for i in range(2):
        moved = []
        for e in (1e-6, -1e-6):
            w = [a.copy() for a in exact.weights["0"]]
            w[i][1] += e
            moved.append(G.Graph(nodes, exact.weights | {"0": w}).entropy(x)[0])
        assert np.isclose((moved[0] - moved[1]) / 2e-6, grads["0"][i][1], rtol=1e-3, atol=1e-6)


def test_replicates_row_by_row(spark):
    rows = [("a", i) for i in range(30)] + [("b", i) for i in range(5)] + [("c", i) for i in range(12)]
    df = spark.createDataFrame(rows, "site string, file_order long")
    got = {(r["site"], r["replicate"], r["file_order"]) for r in sample_replicates(df, ["site"], 10, 3, seed=4).collect()}
    want = {(s, r, i) for s, n in (("a", 30), ("b", 5), ("c", 12)) for r in range(3) for i in (range(n) if n <= 10 else random.Random(4 + r).sample(range(n), 10))}
    assert got == want


def test_scores_are_means_over_draws(spark):
    """250 reads over a site, of which 100 are drawn: each draw is the seeded one, and the score their mean."""
    ref = "ACGT" * 50
    reads = spark.createDataFrame([("NT"[i % 2], i, f"r{i}", 0, "1", 60 + i % 9, 100 + i % 9, i % 60, "40M", ref[60 + i % 9 : 100 + i % 9], [20 + i % 20] * 40) for i in range(500)], "sample string, file_order long, query_name string, flag int, chrom string, ref_start long, ref_end long, mapq int, cigar string, seq string, quals array<int>")
    reference = spark.createDataFrame([("1", 0, ref)], "chrom string, block_start long, seq string")
    site = spark.createDataFrame([("1", 80)], "chrom string, pos long")
    from pilefold.operators import tensors as M
    from pilefold.plans.image_sql import SNV_NET

    network = SNV_NET.graph()
    scored = lambda r: float(network(np.array(r["data"]).reshape(1, 100, 70, 5))[0])
    own = [scored(r) for r in M.snv_tensors(site, reads, reference, 200, replicates=3).collect()]
    assert len(set(own)) == 3
    one = scored(M.snv_tensors(site, reads, reference, 200).first())
    assert any(np.isclose(one, v) for v in own)
    got = P.predict(site, reads, reference, 200, "snv", network, replicates=3).collect()
    assert len(got) == 1 and np.isclose(got[0]["pred_true"], np.mean(own))


def test_the_command_asks_for_models(tmp_path, capsys, spark):
    args = [x for k in ("sample_name", "normal_bam", "tumor_bam", "reference") for x in (f"--{k}", "x")] + ["--output_dir", str(tmp_path)]
    (tmp_path / "x").mkdir()
    for more in ([], ["-snv"], ["--snv_model", "w.npz", "--indel_model", "w.npz"], ["-snv", "--snv_model", "w", "a", "m"]):
        with pytest.raises(SystemExit):
            command.main(["predict", *args, *more])
        assert "_model" in capsys.readouterr().err


# -- .npz files of tensors


def test_npz_files(spark, tmp_path):
    from pilefold.sources.npz import NpzSource

    spark.dataSource.register(NpzSource)
    rows = [(f"{i % 3}", i, [float(i + j) for j in range(6)], None if i == 4 else float(i % 2)) for i in range(25)]
    df = spark.createDataFrame(rows, "chrom string, pos long, data array<float>, label double").repartition(3)
    write = lambda d, mode: d.write.format("npz").option("shape", "1,3,2").option("rows", 4).mode(mode).save(str(tmp_path / "out"))

    def held():
        assert all(p.suffix == ".npz" for p in (tmp_path / "out").iterdir())  # nothing else is left
        return sorted((str(c), int(p), x.ravel().tolist(), None if np.isnan(y) else float(y)) for f in (tmp_path / "out").glob("*.npz") for z in [np.load(f)] for c, p, x, y in zip(z["chrom"], z["pos"], z["X"], z["Y"]) if z["X"].shape[1:] == (1, 3, 2) and len(z["X"]) <= 4)

    write(df, "append")
    assert held() == sorted(rows)
    write(df.filter("pos < 5"), "append")
    assert held() == sorted(rows + rows[:5])
    write(df.filter("pos < 2").drop("label"), "overwrite")
    assert held() == [(c, p, x, None) for c, p, x, _ in sorted(rows[:2])]
    wrong = df.unionByName(spark.createDataFrame([("9", 99, [1.0], 0.0)], df.schema))
    with pytest.raises(Exception, match="reshape"):
        write(wrong, "append")
    assert held() == [(c, p, x, None) for c, p, x, _ in sorted(rows[:2])]
    write(df.limit(0), "append")
    assert len(held()) == 2


# -- spike-in, shards


def test_spiked_reads_are_the_last_ones(spark):
    """A Beta(2, 5) share of the tumor's reads, from the end, gets the base at the site; where a read has a deletion there, it stays."""
    from pilefold.operators.tensors import spiked

    read = lambda i, cigar="10M": {"file_order": i, "flag_reverse": False, "mapq": 60, "seq": "ACGTACGTAC", "quals": [30] * 10, "ref_start": 100, "ref_end": 110, "cigar": cigar}
    one = "struct<file_order:bigint,flag_reverse:boolean,mapq:int,seq:string,quals:array<int>,ref_start:bigint,ref_end:bigint,cigar:string>"
    tumor = [read(i) for i in range(19)] + [read(19, "3M4D7M")]
    df = spark.createDataFrame([("1", 104, 100, "ACGTACGTAC", [read(0)], tumor), ("1", 105, 100, "ACGTACGTAC", None, None)], f"chrom string, pos long, start long, ref string, normal array<{one}>, tumor array<{one}>")
    rows = {r["pos"]: r for r in spiked(df, "T", seed=2).collect()}
    k = round(np.random.default_rng([2, 104]).beta(2, 5) * 20)
    assert 1 < k < 19
    assert [r["seq"] for r in rows[104]["tumor"]] == ["ACGTACGTAC"] * (20 - k) + ["ACGTTCGTAC"] * (k - 1) + ["ACGTACGTAC"]
    assert rows[104]["normal"][0]["seq"] == "ACGTACGTAC" and rows[105]["tumor"] is None


def test_spiked_reads_of_the_reference_base_only(spark):
    """Another base at the site takes of the variant's share and stays; share and variant may be given for each site."""
    from pilefold.operators.tensors import spiked

    read = lambda i, base: {"file_order": i, "flag_reverse": False, "mapq": 60, "seq": base, "quals": [30], "ref_start": 5, "ref_end": 6, "cigar": "1M"}
    one = "struct<file_order:bigint,flag_reverse:boolean,mapq:int,seq:string,quals:array<int>,ref_start:bigint,ref_end:bigint,cigar:string>"
    schema = f"chrom string, pos long, start long, ref string, normal array<{one}>, tumor array<{one}>, variant string, share double"
    made = lambda bases, ref, new, share: tuple(x["seq"] for x in spiked(spark.createDataFrame([("1", 5, 0, ref, None, [read(i, b) for i, b in enumerate(bases)], new, share)], schema)).first()["tumor"])
    assert made("AAAA", "CCCCCa", "G", 0.5) == ("A", "A", "G", "G")
    assert made("ATAATA", "CCCCCA", "G", 0.5) == ("A", "T", "A", "A", "T", "G")
    assert made("AA", "CCCCCA", "G", 0.0) == ("A", "A") and made("AA", "CCCCCA", "G", 1.0) == ("G", "G")
    assert made("AA", "CCC", "G", 1.0) == made("AA", "CCCCCA", None, 1.0) == ("A", "A")  # no reference there, no variant
    assert made("", "CCCCCA", "G", 1.0) == ()


def test_bases_that_fall_by_hand(spark):
    """Columns fill from the top whatever read a base is of; only reads that can show reach a site."""
    from pilefold.operators import tensors as M
    from pilefold.operators.rows import reaching

    ref = "ACGT" * 10
    # file order: two short reads left, one right, then long ones over both
    spans = [(12, 16), (12, 16), (24, 28), (13, 26), (13, 26), (13, 26)]
    reads = spark.createDataFrame([("T", i, f"r{i}", 0, "1", a, b, 60, f"{b - a}M", ref[a:b], [30] * (b - a)) for i, (a, b) in enumerate(spans)], "sample string, file_order long, query_name string, flag int, chrom string, ref_start long, ref_end long, mapq int, cigar string, seq string, quals array<int>")
    reference = spark.createDataFrame([("1", 0, ref)], "chrom string, block_start long, seq string")
    site = spark.createDataFrame([("1", 20)], "chrom string, pos long")
    cfg = M.SnvTensor(flank=8, repeats=1, rows=2, falling=True, allele_fractions=True)
    image = np.array(P.snv_images(site, reads, reference, 64, cfg).first()["data"]).reshape(cfg.shape)
    depth = [sum(a <= at < b for a, b in spans) for at in range(12, 29)]
    assert ((image[:, 17:, 2] > 0).sum(axis=0) == np.minimum(depth, 2)).all() and not image[:, :17, :8].any()
    assert [image[0, 17 + k, 4 + "ATGC".index(ref[12 + k])] for k in range(17)] == [float(d > 0) for d in depth]
    assert (image[:, :, 4:8].sum(axis=2)[:, 17:] == np.array(depth) / np.maximum(depth, 1)).all()
    windows = reads.withColumns({"site": F.lit(20), "w_start": F.lit(12), "w_end": F.lit(29)})
    for limit in range(1, 8):
        seen, want = [0] * 17, set()
        for i, (a, b) in enumerate(spans):
            want |= {i} if any(seen[at - 12] < limit for at in range(a, b)) else set()
            for at in range(a, b):
                seen[at - 12] += 1
        assert {r["file_order"] for r in reaching(windows, ["chrom", "site", "sample"], limit).collect()} == want
    with pytest.raises(ValueError, match="not drawn"):
        P.snv_images(site, reads, reference, 64, cfg, replicates=2)


def test_best_thresholds_of_sets(spark):
    from pilefold.operators.evaluate import benchmarks

    one = spark.createDataFrame([(0.9, 1.0), (0.8, 1.0), (0.4, 0.0), (0.3, 1.0)], "score double, label double")
    got = {r["set"]: r for r in benchmarks({"a": one, "b": one.filter("score > 0.35"), "none": one.limit(0)}).collect()}
    assert set(got) == {"a", "b"} and got["b"]["f1"] == got["b"]["recall"] == 1 and got["b"]["threshold"] == 0.8
    assert np.isclose(got["a"]["f1"], 6 / 7) and got["a"]["threshold"] == 0.3 and (got["a"]["mutations"], got["a"]["positions"]) == (3, 4)


def test_shards_of_keys(spark):
    from pilefold.operators.rows import shard_rows

    df = spark.createDataFrame([(f"p{i % 7}", i) for i in range(30)], "patient string, i long")
    keys = [sorted({r["patient"] for r in shard_rows(df, "patient", 3, s).collect()}) for s in range(3)]
    assert keys == [["p0", "p1", "p2"], ["p3", "p4"], ["p5", "p6"]]
    assert sum(shard_rows(df, "patient", 3, s).count() for s in range(3)) == 30
