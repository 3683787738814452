"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anagrams, bpe, forest, hilbert, langid, lines, lloyd, minhash, mixing, nndescent, quality, secrets, toxicity
from .common import saved


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, model, with_spans=True)
    spans = F.transform("spans", lambda x: F.concat_ws(":", x["lang"], x["first"].cast("string"), x["past"].cast("string")))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_join(spans, ",").alias("spans"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shard_documents(_read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=2, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return nndescent.NeighbourGraph(rows).search(rows.filter(F.col("vec_id") % 100 == 0), k=10)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.KINDS[:3]))
    return found.select("doc_id", *[number(k) for k in secrets.KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lloyd.cluster(_read(spark, sf_dir, "embeddings"), k=16, rounds=3)
    centroid = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(centroid, 256).alias("centroid_sha256"), "copies")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = saved(anagrams.word_counts(_read(spark, sf_dir, "documents")), "words")
    return anagrams.variants(words)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    out = quality.score_documents(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_embedding_near_dedup, op3_language_id, op4_sharding, op5_mixing, op6_bpe, op7_minhash_near_dedup, op8_toxicity, op9_nearest_neighbours, op10_secret_scan, op11_centroid_clustering, op12_spelling_variants, op13_quality)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


OP1_SQL = r"""
WITH l AS (
  SELECT d.rowid_ AS r, doc_id, i, lines[i] AS line, trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d, unnest(range(1, len(lines) + 1)) AS u(i)
), hot AS (SELECT k FROM l WHERE length(k) > 0 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.k = hot.k GROUP BY r
"""

OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS words, sum(w) OVER () - sum(w) OVER x + w AS left_w, sum(cap) OVER x - cap AS filled, row_number() OVER x AS i
  FROM s WINDOW x AS (ORDER BY cap::DOUBLE / w::DOUBLE, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), lv AS (SELECT *, (words - filled)::DOUBLE / left_w::DOUBLE AS lev FROM o),
one AS (SELECT min_by(lev, i) AS lev FROM lv WHERE lev <= cap::DOUBLE / w::DOUBLE),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, one.lev * w::DOUBLE), cap::DOUBLE) AS target FROM lv, one),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
  FROM w, unnest(range(1, greatest(len(ws), 2))) AS u(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id WHERE a.sh IN (SELECT sh FROM rare) GROUP BY 1, 2),
one AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


_NEAREST = """
a{i} AS (
  SELECT q, n, min(c) FILTER (WHERE d = least) AS c, any_value(least) AS d
  FROM (SELECT *, min(d) OVER (PARTITION BY q) AS least FROM (
    SELECT v.q, v.n, t.c, list_sum(list_transform(list_zip(v.q, t.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM distinct_v v, t{i} t))
  GROUP BY q, n
)"""
_MOVED = """
t{j} AS (
  SELECT t{i}.c, coalesce(m.q, t{i}.q) AS q FROM t{i} LEFT JOIN (
    SELECT c, list(floor_ ORDER BY i) AS q
    FROM (SELECT c, i, CASE WHEN sum(n * q[i]) >= 0 THEN sum(n * q[i]) // sum(n) ELSE -((sum(n) - 1 - sum(n * q[i])) // sum(n)) END::BIGINT AS floor_ FROM a{i}, unnest(range(1, 65)) AS u(i) GROUP BY c, i)
    GROUP BY c
  ) m ON m.c = t{i}.c
)"""
OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), distinct_v AS (SELECT q, count(*)::BIGINT AS n FROM v GROUP BY q),
t0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16),
{",".join(_NEAREST.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(3))},{_NEAREST.format(i=3)},
cost AS (SELECT c, sum(n * d)::BIGINT AS cluster_inertia FROM a3 GROUP BY c)
SELECT v.vec_id, a3.c::INT AS cluster, a3.d AS distance, cost.cluster_inertia, (SELECT sum(cluster_inertia) FROM cost)::BIGINT AS inertia,
       sha256(array_to_string(t3.q, ',')) AS centroid_sha256, a3.n AS copies
FROM v JOIN a3 USING (q) JOIN cost ON cost.c = a3.c JOIN t3 ON t3.c = a3.c
"""

#: The crc32 is taken byte by byte with a table that the polynomial gives.
OP12_SQL = r"""
WITH RECURSIVE bits(b, k, x) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY 1, 2
), h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(regexp_replace(hex(encode(doc || ':' || w)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda s: ('0x' || s)::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM r, tab
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM near GROUP BY a),
forms AS (SELECT best.a, n_near, top, min(b) AS form FROM best JOIN near ON near.a = best.a AND near.n = best.top GROUP BY ALL),
f AS (
  SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * words.n THEN form END AS form, CASE WHEN top >= 5 * words.n THEN top END::BIGINT AS form_n
  FROM words LEFT JOIN forms ON forms.a = words.word
), chain(word, past) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.past WHERE f.form IS NOT NULL),
root AS (SELECT chain.word, chain.past AS root FROM chain JOIN f ON f.word = chain.past WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root ON root.word = f.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op1_line_dedup": OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "op5_mixing": OP5_SQL, "op7_minhash_near_dedup": OP7_SQL}
