"""Every operator and every pipeline stage on awkward rows: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from pilefold.llm import bpe, forest, hilbert, langid, lines, minhash, mixing, nndescent, secrets, toxicity
from pilefold.llm.queries import tokenizer_path

#: Names that operators use for columns of their own.
CLASHES = [
    "_row", "_r1", "_r2", "_gone", "_pos", "_key", "h1", "h2", "n", "key", "n_lines", "N_Dropped", "kept_text", "_source", "_rate", "_of", "_n", "_i", "copies", "size", "source_size", "target", "w", "cap",
    "shard", "slot", "_shard", "_crc", "_c", "_d", "hilbert", "text_crc32", "_rank", "_value", "_d0", "_part", "bands", "band", "component_id", "kept", "id", "s", "rep", "spans", "score", "lang_pred", "ids", "n_tokens", "a.b",
]
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "\n\n", "en", "s", 2), (None, "null id here", "en", "s", 1), (None, None, None, None, None), (4, "a b c d e f g\nlast", "en", "s", 9),
    (5, "A B c d e f g\nlast", "en", None, 9), (5, "A B c d e f g\nlast", "en", None, 9), (6, "word " * 30000, "en", "s", 1), (7, "12 !!", "de", "t", 1), (8, "x" * 100_000, None, "t", 1), (9, "日本語 " * 20_000, "ja", "t", 1),
]


def _key(row) -> tuple:
    return tuple("" if x is None else str(x)[:40] for x in row)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def vectors(spark):
    one, two = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(1, one), (2, two), (2, two), (3, one), (None, one), (4, None), (5, []), (6, [0.0] * 3), (7, [float("nan"), 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0, 0.0]), (10, [1.0, 0.001]), (11, [float("inf"), 0.0, 0.0]), (12, [-1.0, 0.0, 0.0]), (13, [1e-30, 0.0, 5e-31])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "m", "v", "leaf", "leaves", "u", "d", "q", "rank", "lo", "hi", "component_id")})


def _model(docs):
    return langid.fit(docs)


OPERATORS = {
    "lines": lambda d: lines.dedup_lines(d, min_docs=3), "language": lambda d: langid.identify(d, _model(d), with_spans=True), "kept": lambda d: langid.keep_identified(d, _model(d)),
    "shards": hilbert.shard_documents, "mix": mixing.mix, "mixed": mixing.mixed, "bpe": lambda d: bpe.encode_documents(d, tokenizer_path(), with_ids=True), "minhash": lambda d: minhash.near_duplicates(d, words=2),
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))), "secrets": secrets.find_secrets,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    if name not in ("kept", "mixed"):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    empty = OPERATORS[name](docs.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_passed_through_columns(docs):
    """Operators that hand rows on keep every column, but for names that they define themselves."""
    want = {(c, f"own {c}") for c in CLASHES}
    got = lines.dedup_lines(docs, min_docs=3)
    own = {"n_lines", "n_dropped", "kept_text"}
    r = got.filter("doc_id = 4").first()
    assert {(c, r[c]) for c in CLASHES if c.lower() not in own} == {x for x in want if x[0].lower() not in own}
    assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (2, 2, "")
    for out in (mixing.mixed(docs), langid.keep_identified(docs, _model(docs))):
        assert out.columns == docs.columns and out.count() > 0 and all((c, r[c]) in want for r in out.collect() for c in CLASHES)


def test_lines_without_ansi(spark, docs):
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert {r["n_dropped"] for r in lines.dedup_lines(docs, min_docs=3).collect()} == {0, 2}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_line_runs_leave_no_files(spark, docs, tmp_path, monkeypatch):
    from pilefold.llm import common

    for module in (common, lines):
        monkeypatch.setattr(module, "scratch", lambda spark, name: str(tmp_path / name))
    assert lines.dedup_lines(docs, min_docs=3, batches=4, fanout=2).count() == len(ROWS)
    assert [p.name for p in tmp_path.iterdir()] == ["hot-lines"]  # what the result still reads


def test_written_shards(spark, docs, tmp_path):
    hilbert.write_shards(docs, str(tmp_path / "s"), shards=3)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert set(got.columns) == {*docs.columns, "shard_"} and sorted(_key(r) for r in got.select(*[f"`{c}`" for c in docs.columns]).collect()) == sorted(_key(r) for r in docs.collect())


def test_scratch_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from pilefold.llm import common

    conf = N(get=lambda key: None)
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch(N(sparkContext=N(getConf=lambda: conf, master=master, applicationId="a")), "t")


def test_vectors(spark, vectors):
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(vectors).collect())
    lone = [(str(i), 0, i, True) for i in (4, 5, 6, 7, 8, 11, 12)]
    # Vectors of a length are compared among themselves: 9 and 10 have two components. 13 points where 1 and 3 do.
    linked = [("1", 3, 1, True), ("3", 3, 1, False), ("13", 3, 1, False), ("2", 3, 1, False), ("2", 3, 1, False), ("9", 1, 9, True), ("10", 1, 9, False), ("None", 0, None, True)]
    assert got == sorted(lone + linked)
    assert forest.near_duplicates(vectors.limit(0)).count() == 0
    index = nndescent.NeighbourGraph(vectors)
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in index.search(vectors.filter("vec_id in (1, 4, 9) or vec_id is null"), k=3).collect()}
    assert found == {(1, 1): 3, (1, 2): 2, (1, 3): 13, (9, 1): 10}
    assert nndescent.NeighbourGraph(vectors.limit(0)).search(vectors.limit(0)).count() == 0


def test_stages(spark, docs):
    """Each pipeline stage on all of these rows: same columns, rows kept or dropped as stated, empty tables empty."""
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, docs.limit(0), "")
        rows = out.collect()
        assert none.count() == 0 and none.columns == out.columns
        assert name == "BPE" or out.columns == docs.columns
        ids = sorted(str(r["doc_id"]) for r in rows)
        every = sorted(str(r[0]) for r in ROWS)
        if name == "language ID":
            assert "4" in ids and not {"1", "2", "3", "7"} & set(ids)
        elif name in ("line dedup", "BPE"):
            assert ids == every
        elif name == "MinHash near-dedup":
            assert ids == [x for x in every if x != "5"]
        else:
            assert set(ids) <= set(every) and rows
