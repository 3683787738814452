"""Centroid clustering, spelling variants and quality: brute force, gradients by differences, held-out accuracy, awkward rows. Line dedup of very many lines."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilefold.llm import anagrams, lines, lloyd, quality
from pilefold.llm.queries import op13_quality

SF = "/root/testdata/sf0.001"


# -- centroid clustering


def lloyd_by_hand(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cents = [q for _, q in first]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min(range(len(cents)), key=lambda j: (far(q, cents[j]), j))
    for _ in range(rounds):
        at = [near(q) for _, q in kept]
        for j in range(len(cents)):
            mine = [q for (_, q), c in zip(kept, at) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(q), far(q, cents[near(q)]), tuple(cents[near(q)])) for i, q in kept]
    cost = Counter()
    for _, c, d, _ in out:
        cost[c] += d
    copies = Counter(tuple(q) for _, q in kept)
    return sorted((str(i), c, d, min(cost[c], lloyd.LONG), min(sum(cost.values()), lloyd.LONG), cent, copies[tuple(q)]) for (i, c, d, cent), (_, q) in zip(out, kept))


def clusters(df, **how):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"]), r["copies"]) for r in lloyd.cluster(df, **how).collect())


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e7])
def test_clusters_by_hand(spark, scale):
    """Components of each width: sums in doubles, in longs and in Python's integers."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, scale, 4)).tolist()) for i in range(60)] + [(i, [scale, 0.0, -scale, 0.25]) for i in range(100, 140)]
    rows += [(7, [0.5] * 4), (7, [0.5] * 4), (None, [0.25] * 4), (200, None), (201, [1.0] * 3), (202, [None, 1.0, 1.0, 1.0]), (203, [float("nan")] + [0.0] * 3), (204, [float("inf")] + [0.0] * 3), (205, [0.0] * 4), (206, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("q", "n", "cluster", "c", "distance", "copies", "h")})
    assert clusters(df, k=5, dim=4) == lloyd_by_hand(rows, 5, 3, 4)


def test_fewer_rows_than_centroids_and_none(spark):
    rows = [(3, [1.0, 2.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters(df, k=5, dim=2) == lloyd_by_hand(rows, 5, 3, 2)
    assert lloyd.cluster(df, dim=3).count() == 0 and lloyd.cluster(df.limit(0)).count() == 0


def test_components_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r[0]: r for r in clusters(df, k=1, dim=2)}
    assert len(got) == 3 and got["1"][2] == got["2"][2] == lloyd.LONG and got["3"][4] == lloyd.LONG


# -- spelling variants


def words_by_hand(docs, least=5):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least}


def near_by_hand(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and x != w and near_by_hand(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 5 * n else None, n, len(near)]
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return sorted((w, str(f), root(w), n, k, words[f] if f else None) for w, (f, n, k) in out.items())


def variants(df):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], r["form_n"]) for r in anagrams.variants(df).collect())


def test_words_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(None, "Ünïted ÉTUDES x×÷yabc " * 6), (9, None), (9, ""), (9, "a" * 5000 + " " + "longer_words7between " * 3), (9, "longer_words7between " * 3), (1, "1" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "half")})
    got = {r["word"]: r["n"] for r in anagrams.word_counts(df).collect()}
    assert got == words_by_hand(rows)
    assert anagrams.word_counts(df.limit(0)).count() == 0


def test_words_across_chunks_and_flushes(spark):
    text = " ".join(f"wörter{i % 7 * 'x'} abc" for i in range(4000))
    assert "".join(anagrams._chunks(text, 100)) == text and len(list(anagrams._chunks(text, 100))) > 100
    runs = re.compile("[A-Za-zÀ-ÿ]+")
    assert [w for c in anagrams._chunks(text, 100) for w in runs.findall(c)] == runs.findall(text)
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in anagrams.word_counts(df, most_held=3).collect()} == words_by_hand([(i, text) for i in range(3)])


def test_variants_of_random_words(spark):
    """Few letters, so that anagrams, chains, ties and words near in several ways abound."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 9))): int(5 ** rng.integers(1, 6)) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants(df) == variants_by_hand(words)
    assert variants(df.limit(0)) == []


def test_no_table_of_words_is_broadcast(spark):
    """Spark sizes what stands under keys by the file of words, so a file below its limit may hold far more rows than the driver does."""
    from pilefold.llm.common import saved

    words = saved(spark.createDataFrame([("abcdef", 60), ("abcdeg", 10), ("abcdegh", 2), ("uvwxyz", 5)], "word string, n long"), "words")
    for out in (anagrams.near_pairs(words), anagrams.variants(words)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r["word"]: r["root"] for r in out.collect()} == {"abcdef": "abcdef", "abcdeg": "abcdef", "abcdegh": "abcdef", "uvwxyz": "uvwxyz"}


def test_chain_of_forms_and_anagrams(spark):
    words = {"stone" + "s" * i: 5**i for i in range(1, 9)} | {"notess": 10, "onsets": 10, "seaton": 5, "x" * 3000: 5, "x" * 2999: 25, "x" * 1500 + "y" + "x" * 1499: 5}
    got = variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got == variants_by_hand(words)
    assert {r[0]: r[2] for r in got}["stones"] == "stone" + "s" * 8


# -- quality


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = quality.Network(seed=3)
    x = rng.integers(0, 257, (6, 40))
    y = np.array([0, 1, 1, 0, 1, 0.0])
    params = [net.embed, net.filters, net.bias, net.out, net.shift]
    real = net.table
    net.tables = lambda: setattr(net, "table", np.einsum("bd,kdf->kbf", net.embed, net.filters))  # in doubles
    net.tables()
    _, grads = net.gradients(x, y)
    for p, g in zip(params, grads):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(25)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            keep, e, loss = p[at], 1e-5, []
            for v in (keep + e, keep - e):
                p[at] = v
                net.tables()
                loss.append(net.gradients(x, y)[0])
            p[at] = keep
            net.tables()
            assert abs((loss[0] - loss[1]) / (2 * e) - g[at]) < 1e-6
    assert real.dtype == np.float32


@pytest.mark.parametrize("text", ["", "a", "short text", "é" * 127, "x" * 128, "y" * 129, "z" * 256, "word " * 20_000])
def test_logits_by_hand(text):
    """Window by window: each chunk holds 256 starts, chunks start 128 apart, all bytes are covered; a long text in pieces gives the same."""
    net = quality.Network()
    raw = list(text.encode())
    ids = raw + [256] * (5 if raw else 6)
    n = len(ids) - 5
    at = range(n) if n < 1000 else range(0, n, 1)
    answers = np.array([sum(net.table[k][ids[i + k]] for k in range(6)) for i in at])
    starts = range(0, max(n - 128, 1), 128)
    want = [np.maximum(answers[s : s + 256].max(0) + net.bias, 0) @ net.out + net.shift[0] for s in starts]
    np.testing.assert_allclose(net.logits(text), want, rtol=1e-5, atol=1e-5)
    assert starts[-1] + 256 >= n


def test_quality_held_out(spark):
    out = op13_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert out["score"].between(0, 1).all()
    held = out[out["held_out"]]
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() >= 0.95
    assert out.groupby("quality")["score"].mean().diff().iloc[-1] > 0.7


def test_quality_without_classes_and_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "null id"), (3, "text " * 50_000)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "quality", "x")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    for m in (model, None, quality.fit(docs, labels.filter("quality = 1"))):
        rows = quality.score_documents(docs, m).collect()
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "2", "3", "None"] and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.filter("quality = 1")) is None


# -- line dedup


def test_line_dedup_is_linear_in_a_texts_lines(spark):
    """Every other of 500,000 lines is shared: four times the lines take far less than sixteen times as long (1,000,000 would have taken hours by looking each line up in an array)."""
    took = {}
    for n in (1000, 125_000, 500_000):
        shared = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.when(x % 2 == 0, F.concat(F.lit("s"), x.cast("string"))).otherwise(F.concat(F.lit("o"), x.cast("string"), F.lit("_"), F.col("doc_id").cast("string"))))
        docs = spark.range(2).select(F.col("id").alias("doc_id")).withColumn("text", F.array_join(shared, "\n"))
        began = time.time()
        rows = lines.dedup_lines(docs, min_docs=2, batches=1).collect()
        took[n] = time.time() - began
        assert all(r["n_lines"] == n and r["n_dropped"] == n // 2 and r["kept_text"].count("o") == n // 2 and "s" not in r["kept_text"] for r in rows)
    assert took[500_000] < 8 * took[125_000]
