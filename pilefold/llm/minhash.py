"""MinHash near-dedup with min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so
`perms` permutations cost half the hash evaluations of as many plain MinHash values. Bands are `width`
minima or `width` maxima; with the defaults (120 permutations, 40 bands of 6) a pair at similarity 0.8
shares no band with probability (1 - 0.8^6)^40 = 5e-6, and one at 0.3 shares one in 3% of cases.

Sharing a band only proposes: every link is confirmed by |A & B| * 100 >= |A | B| * 80 on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, slices
from .components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


class _WordHashes(dict):
    """Hashes of words as they come; starts over at 150,000, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words (A-Z lower-cased, six blanks): a shorter sequence is one shingle, no word none."""
    seq = text.encode().lower().split() if text else []  # of bytes, lower() and split() know ASCII alone
    if not seq:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_words.__getitem__, seq), "u8", len(seq))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), "u8")
    for k in range(min(words, len(h))):
        out = _stir(out * MIX + h[k : k + n])
    return np.unique(out)


def permutations(perms: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, perms, dtype="u8") * _U(2) + _U(1)


def band_hashes(s: np.ndarray, factors: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band: the first half of the bands from minima, the other from maxima."""
    low, high = np.full(len(factors), ~_U(0)), np.zeros(len(factors), "u8")
    for at in range(0, len(s), 4096):
        seen = (s[at : at + 4096, None] ^ (s[at : at + 4096, None] >> _U(32))) * factors
        np.minimum(low, seen.min(axis=0), out=low)
        np.maximum(high, seen.max(axis=0), out=high)
    values = np.concatenate([low, high]).reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype="u8")
    for k in range(values.shape[1]):
        out = _stir(out * MIX + values[:, k])
    return out.view("i8")


#: Buckets of more classes are compared in cells of two blocks of about BLOCK classes.
SMALL, BLOCK = 16, 400


def _similar(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a cell's outsiders: one to each other component that has a similar enough member."""
    out = pdf["outsider"].to_numpy()
    mem, sat = pdf[~out].reset_index(drop=True), pdf[out].reset_index(drop=True)
    found: list[tuple[int, int]] = []
    if len(mem) and len(sat):
        size = np.array([len(s) for s in mem["s"]])
        tokens, owner = np.concatenate(mem["s"].to_list()), np.repeat(np.arange(len(mem)), size)
        comps, reps = mem["c"].to_numpy(), mem["rep"].to_numpy()
        for at in range(0, len(sat), 16):
            some = sat.iloc[at : at + 16]
            known = np.unique(np.concatenate(some["s"].to_list()))
            mark = np.zeros((len(known), len(some)), "i4")
            for k, s in enumerate(some["s"]):
                mark[np.searchsorted(known, s), k] = 1
            where = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            hit = known[where] == tokens
            if not hit.any():
                continue
            who = owner[hit]
            first = np.nonzero(np.diff(who, prepend=-1))[0]
            common = np.zeros((len(mem), len(some)), "i8")
            common[who[first]] = np.add.reduceat(mark[where[hit]], first, axis=0)
            for k, (rep, c, s) in enumerate(zip(some["rep"], some["c"], some["s"])):
                i = common[:, k]
                near = np.nonzero((i * 100 >= (size + len(s) - i) * percent) & (comps != c))[0]
                for _, m in sorted({int(comps[m]): int(reps[m]) for m in near[::-1]}.items()):
                    found.append((min(rep, m), max(rep, m)))
    return pd.DataFrame(found, columns=["a", "b"], dtype="i8")


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across the components of large buckets. rows: (h, rep, c, main, g, gs, s)."""
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = rows.select("h", "rep", "c", "s", F.lit(False).alias("outsider"), block("g", 1).alias("i"), every("gs").alias("j"))
    outer = rows.filter("c <> main").select("h", "rep", "c", "s", F.lit(True).alias("outsider"), every("g").alias("i"), block("gs", 2).alias("j"))
    return inner.unionByName(outer).groupBy("h", "i", "j").applyInPandas(lambda pdf: _similar(pdf, percent), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. array_intersect runs in the JVM; the exchange carries two sets a pair."""
    one = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, perms: int = 120, bands: int = 40, seed: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs, whole texts.

    1. One pass over the texts: set size, two 64-bit hashes of the whole set, band hashes.
    2. Equal sets are one class, named by its smallest doc_id; only classes go on.
    3. In each bucket of a band a leader is drawn by hash; each class is a candidate with the leaders of
       its buckets, so a bucket of n classes gives n - 1 pairs. First each class is confirmed against one
       leader; pairs inside a component that has formed are not needed any more; the rest is confirmed.
    4. What is exact is not left to leaders: in buckets in which several components remain, each class
       outside the bucket's main component is compared with every class of another component. Small
       buckets give pairs; larger ones are dealt out as cells of two bounded blocks, in which sets are
       compared without a row for each pair.
    Components are over confirmed links. A text without words has an empty set, links with nothing and is
    kept; so is a row whose doc_id is null (component null). Rows that repeat a doc_id count as one
    document with several texts. Other columns are not read; an empty table gives an empty result.
    """
    factors = permutations(perms, seed)

    def signed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            n, h1, h2, rows = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                h1.append(xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63))
                h2.append(xxhash.xxh64_intdigest(s.tobytes(), 2) - (1 << 63))
                rows.append(band_hashes(s, factors, bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.array(rows, pa.list_(pa.int64()))],
                names=["doc_id", "n", "h1", "h2", "bands"],
            )

    signatures = saved(docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n long, h1 long, h2 long, bands array<long>"), "signatures")
    some = signatures.filter("n > 0 and doc_id is not null")
    # Written on its own: a group of copies of any size meets its class in a join of two tables, which can be split.
    classes = saved(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    # By id too, so that the copies of a text aren't dealt to one task to find the one that names them.
    named_by = some.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "h1", "h2"], "left_semi")
    bucketed = named_by.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "h")).select("rep", F.xxhash64("band", "h").alias("h"))
    # Buckets with more than one class: partial aggregation first, then only their members.
    leader = F.min(F.struct(F.xxhash64("h", "rep").alias("by"), "rep"))["rep"]
    # Written on its own: a join after an aggregation by the same key can't split a hot bucket, a join of two tables can.
    shared = saved(bucketed.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), leader.alias("leader")).filter("lo < hi").select("h", "leader"), "shared")
    members = saved(bucketed.join(shared, "h"), "members")
    pairs = saved(members.filter("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct(), "pairs")

    def setted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts, 200):
            rows = [shingles(t, words).view("i8") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["id", "s"])

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = saved(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(setted, "id long, s array<long>"), "sets")

    def grown(links: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = saved(links.unionByName(fresh), "links") if links is not None else saved(fresh, "links")
        return links, saved(components(links), "components")

    def across(p: DataFrame, comp: DataFrame) -> DataFrame:
        """The pairs whose ends are not in one component yet."""
        of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        return p.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    first = pairs.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a")).select("a", "b")
    links, comp = grown(None, _verified(first, sets, percent))
    second = saved(across(pairs.join(first, ["a", "b"], "left_anti"), comp), "second")
    links, comp = grown(links, _verified(second, sets, percent))

    inside = members.select("h", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", F.coalesce("component", "rep").alias("c"))
    per = inside.groupBy("h", "c").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("main"))
    per = per.filter("main.n < n").select("h", "n", F.col("main.c").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("g"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("gs"))
    per = saved(per, "per")
    open_rows = saved(inside.join(per, "h"), "open")
    x, y = (open_rows.filter(F.col("n") <= SMALL).select("h", F.col("rep").alias(n), F.col("c").alias(f"c{n}")) for n in "ab")
    third = x.join(y, "h").filter("ca <> cb and a < b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    large = open_rows.filter(F.col("n") > SMALL).join(sets.withColumnRenamed("id", "rep"), "rep")
    cells = _cells(large, percent)
    links, comp = grown(links, _verified(third, sets, percent).unionByName(cells))
    for t in (pairs, second, open_rows, members, sets, shared, per):
        forget(t)

    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("c"))
    out = signatures.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
