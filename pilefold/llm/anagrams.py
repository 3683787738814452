"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' values, the fifth powers of their code points, so anagrams share a
key and one added, removed or exchanged letter moves it by one value or by the difference of two. Two
words whose keys differ so meet under one key: each word stands under its own key and under its key less
the value of each of its letters (an exchange is what two words have in common once one letter is taken
from each). Words under one key may still be many anagrams; as one changed letter leaves the first or the
last half alone, they meet only where one of these is the same too, and then the letter order decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, slices

LETTERS = "A-Za-zÀ-ÿ"
OTHER = re.compile(f"[^{LETTERS}]")


def _chunks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about `size` characters that cut no run of letters."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            stop = OTHER.search(text, end)
            end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, least_letters: int = 6, least: int = 5, every: int = 199, most_held: int = 200_000) -> DataFrame:
    """(word, n) of the words that occur `least` times over all documents.

    A word is a maximal run of letters with A-Z lower-cased, less one code point (h % length) where `every`
    divides h, the crc32 of "<doc_id>:<run>"; a null id counts as the empty text, a null text has no words.
    Tasks add up to `most_held` words at a time before they hand them on.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in slices(parts):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for chunk in _chunks(text or ""):
                    words = runs.findall(chunk.encode().lower().decode())  # of bytes, lower() changes A-Z only
                    held.update(words)
                    cut = {w for w in set(words) if not zlib.crc32(w.encode(), prefix) % every}
                    for word, n in Counter(w for w in words if w in cut).items() if cut else ():
                        at = zlib.crc32(word.encode(), prefix) % len(word)
                        held[word] -= n
                        held[word[:at] + word[at + 1 :]] += n
                    if len(held) >= most_held:
                        yield _batch(held)
                        held.clear()
        yield _batch(held)

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    counts = counts.filter(F.length("word") >= least_letters)  # a cut may fall below
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _batch(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _places(word: str) -> Iterator[tuple[int, str, bool]]:
    """(key, half, whole word or not) under which a word stands; the half starts with the side that it is of."""
    values = {c: ord(c) ** 5 for c in set(word)}
    key = sum(values[c] for c in word)
    for less, whole in [(0, True), *((v, False) for v in values.values())]:
        h = (len(word) + whole) // 2
        k = (key - less) % (1 << 63)
        yield k, "<" + word[:h], whole
        yield k, ">" + word[len(word) - h :], whole


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a < b, of the words (word, n) that differ by exactly one inserted, deleted or replaced code point, each pair once.

    A word stands under some 20 keys, but Spark sizes these rows by the file of words, and would send them to all executors by way of the
    driver; so the join is by sorted runs, whatever the size.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts, 5000):
            rows = [(*place, word, n) for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for place in _places(word)]
            types = (pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["key", "half", "whole", "word", "n"])

    stands = words.select("word", "n").mapInArrow(run, "key long, half string, whole boolean, word string, n long")
    a = stands.select("key", "half", F.col("whole").alias("w_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = stands.select("key", "half", F.col("whole").alias("w_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = a.hint("merge").join(b, ["key", "half"]).filter("a < b and not (w_a and w_b)")
    # under the last half only if the first halves, as long, differ: else the pair meets there too
    once = F.expr("substring(half, 1, 1) = '<' or substring(a, 1, length(half) - 1) <> substring(b, 1, length(half) - 1)")
    return met.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of words (word, n), words once each.

    n_near: its near words. form: the one of largest n, ties to the smallest in code-point order, if that n
    is at least `times` its own. root: where following forms ends. Forms get `times` more frequent with each
    step, so chains are short; they are followed by doubling, over the words that have a form only. Tables of
    words grow with the input, and files of them are far smaller than their rows: none is broadcast.
    """
    pairs = near_pairs(words)
    to = lambda x, n_x, y, n_y: pairs.select(F.col(x).alias("word"), F.col(n_x).alias("n"), F.struct((-F.col(n_y)).alias("less"), F.col(y).alias("near")).alias("best"))
    alone = words.select("word", "n", F.lit(None).cast("struct<less:bigint,near:string>").alias("best"))
    seen = alone.unionByName(to("a", "n_a", "b", "n_b")).unionByName(to("b", "n_b", "a", "n_a"))
    seen = seen.groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= times * F.col("n")
    found = saved(seen.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "variants")

    now = saved(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(now.hint("merge").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        moved = step.filter("moved").limit(1).count()
        now = step.drop("moved")
        if not moved:
            break
    out = found.hint("merge").join(now, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
