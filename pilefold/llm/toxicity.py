"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density and number of lexicon words (as they stand, and after common letter
substitutions are undone), the densest stretch, lexicon words near the second person, capitals,
punctuation, obfuscated words, length. The lexicon is learned: words whose document frequency differs most
between the classes of the training rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sampled, slices

#: Second-person words of the common languages here.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti vosotros".split())
#: Characters that stand for letters.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
#: Web and mail addresses: what they hold is no word of the text.
ADDRESS = re.compile(r"://|@[^@]*\.[^\W\d_]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ["density", "hits", "distinct", "undone", "densest", "near_second", "second", "capitals", "shouted", "exclaim", "punctuation", "obfuscated", "length"]


def _core(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>*_-~#$%&|/\\…«»“”")


class Features:
    """Features by a lexicon; flags of words are remembered, up to `keep` of them."""

    def __init__(self, lexicon: frozenset[str], keep: int = 150_000, near: int = 4, stretch: int = 20):
        self.lexicon, self.keep, self.near, self.stretch = lexicon, keep, near, stretch
        self.flags: dict[str, int] = {}

    def _flag(self, word: str) -> int:
        """1 lexicon, 2 lexicon once substitutions are undone, 4 second person, 8 shouted, 16 obfuscated."""
        core = _core(word)
        low = core.lower()
        f = 1 if low in self.lexicon else 0
        if not f and not core.isalpha() and any(c.isalpha() for c in core) and not ADDRESS.search(core):
            f |= 1 * any(run in self.lexicon for run in re.findall(r"[^\W_]+", low))  # glued words, cut as the lexicon's were
            if not f and not re.search(r"\d{4}", core):
                undone = ("".join(c for c in part.translate(SUBSTITUTES) if c.isalpha()) for part in (low, *re.split(r"[,;:./=]+", low)))
                hit = any(x in self.lexicon for x in undone)
                f |= 2 * hit | 16 * (hit or not re.search(r"[=@:/]", core))
        f |= 4 * (low in SECOND) | 8 * (len(core) > 1 and core.isupper())
        if len(self.flags) >= self.keep:
            self.flags.clear()
        self.flags[word] = f
        return f

    def row(self, text: str | None) -> list[float]:
        words = text.split() if text else []
        if not words:
            return [0.0] * len(NAMES)
        get, flag = self.flags.get, self._flag
        f = np.array([flag(w) if (x := get(w)) is None else x for w in words], "u1")
        n, bad = len(f), (f & 3) > 0
        hits = int(bad.sum())
        densest = near = distinct = 0
        at = np.nonzero(bad)[0]
        if hits:
            ends = np.searchsorted(at, at + self.stretch)
            densest = int((ends - np.arange(hits)).max())
            you = np.nonzero(f & 4)[0]
            if len(you):
                i = np.searchsorted(you, at)
                gap = np.minimum(np.abs(at - you[np.minimum(i, len(you) - 1)]), np.abs(at - you[np.maximum(i - 1, 0)]))
                near = int((gap <= self.near).sum())
            distinct = len({_core(words[i]).lower() for i in at})
        raw = text.encode()
        share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
        count = lambda bit: int((f & bit > 0).sum()) / n
        return [hits / n, math.log1p(hits), distinct, count(2), densest, near / n, count(4), share(CAPITALS) * n / len(raw), count(8), share(b"!"), share(b".,;:?"), count(16), math.log1p(n)]


class Trees:
    """Boosted regression trees for the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = math.log(p / (1 - p))
        self.trees, f = [], np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._walk(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def _grow(self, b, g, h, ids, depth):
        gs, hs = g[ids].sum(), h[ids].sum()
        best = (1e-6, None, None)
        if depth and len(ids) >= 2 * self.least:
            for c in range(b.shape[1]):
                n = len(self.edges[c]) + 1
                left_g, left_h, left_n = (np.cumsum(np.bincount(b[ids, c], weights=w, minlength=n))[:-1] for w in (g[ids], h[ids], None))
                gain = left_g**2 / (left_h + self.ridge) + (gs - left_g) ** 2 / (hs - left_h + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(left_n < self.least) | (len(ids) - left_n < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), c, int(gain.argmax()))
        if best[1] is None:
            return self.rate * gs / (hs + self.ridge)
        left = b[ids, best[1]] <= best[2]
        return best[1], best[2], self._grow(b, g, h, ids[left], depth - 1), self._grow(b, g, h, ids[~left], depth - 1)

    def _walk(self, tree, b) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        left = b[:, tree[0]] <= tree[1]
        out = np.empty(len(b))
        out[left], out[~left] = self._walk(tree[2], b[left]), self._walk(tree[3], b[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both rising; one Beta(1, 1) pseudo-count keeps ends off 0 and 1."""
    blocks: list[list[float]] = []
    for s, v in sorted(zip(score.tolist(), y.tolist())):
        blocks.append([s, s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs, ps = [], []
    for low, high, hit, n in blocks:
        xs += [low, high] if high > low else [low]
        ps += [(hit + 0.5) / (n + 1)] * (2 if high > low else 1)
    return np.array(xs), np.maximum.accumulate(np.array(ps))


def learn_lexicon(rows: DataFrame, size: int = 200, least: int = 5, ratio: float = 6.0) -> frozenset[str]:
    """At most `size` words whose smoothed rate of documents is `ratio` times higher in class 1. rows: (text, toxic). Counted by Spark; only the words that pass come back."""
    total = rows.groupBy("toxic").count().toPandas().set_index("toxic")["count"].to_dict()
    if not total.get(1) or not total.get(0):
        return frozenset()
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    counts = rows.select("toxic", F.explode(words).alias("w")).filter(F.length("w") > 1).groupBy("w").agg(F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lift = (F.col("a") + 0.5) / (total[1] + 1.0) / ((F.col("b") + 0.5) / (total[0] + 1.0))
    top = counts.filter(F.col("a") >= least).withColumn("lift", lift).filter(F.col("lift") >= ratio)
    top = top.orderBy(F.desc(F.col("a") * F.log("lift")), "w").limit(size)
    return frozenset(r["w"] for r in top.select("w").toLocalIterator())


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> dict | None:
    """A model from about `sample` labelled rows (all, if no more), by a hash of the id, of which one in four calibrates. None without both classes. The driver gets their feature rows only."""
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = sampled(marked, sample, 29, "doc_id")
    rows = docs.filter("text is not null").select("doc_id", "text").join(marked, "doc_id").select("doc_id", "text", "toxic")
    lexicon = learn_lexicon(rows)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in slices(parts):
            got = [features.row(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = rows.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(counted, "doc_id long, toxic int, x array<double>").toPandas()
    got = got.sort_values("doc_id", ignore_index=True)  # the same model on every run
    if got.empty or got["toxic"].nunique() < 2:
        return None
    x, y = np.stack(got["x"].to_numpy()), got["toxic"].to_numpy("f8")
    hold = np.random.default_rng(1).random(len(x)) < 0.25
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold[:] = False
    trees = Trees().fit(x[~hold], y[~hold])
    knots = isotonic(trees.raw(x[hold]), y[hold]) if hold.any() else isotonic(trees.raw(x), y)
    return {"lexicon": lexicon, "trees": trees, "knots": knots}


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every row, whole texts, null as empty; 0 everywhere if nothing could be learned. A narrow pass over doc_id and text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of 200 words and 60 small trees

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        features = Features(m["lexicon"]) if m else None
        for batch in slices(parts):
            score = np.zeros(batch.num_rows)
            if m and batch.num_rows:
                x = np.array([features.row(t) for t in batch.column("text").to_pylist()])
                score = np.interp(m["trees"].raw(x), *m["knots"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id, folds: int = 5, fold: int = 0):
    return crc_mod(doc_id, folds) == fold
