"""Language identification of mixed-language text.

A word's script narrows the languages that may score it; each candidate scores the word by hashed
character n-grams (naive Bayes, lengths 2 to 4 with the word's ends marked); Viterbi over the words with a
switching penalty labels spans. A document's language is the one whose spans hold most letters.

A text is scored in pieces of about 65,536 characters, cut between words, so what a long text needs is its
words' scores (languages * 8 bytes a word) and one back pointer a word and language, whatever its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sampled, slices

CELLS = 1 << 16
#: Script ranges (first code point, past the last, name) by Unicode block.
SCRIPTS = [
    (0x0041, 0x0250, "latin"), (0x0250, 0x0370, "latin"), (0x0370, 0x0400, "greek"), (0x0400, 0x0530, "cyrillic"), (0x0530, 0x0590, "armenian"),
    (0x0590, 0x0600, "hebrew"), (0x0600, 0x0780, "arabic"), (0x0900, 0x0980, "devanagari"), (0x0980, 0x0A00, "bengali"), (0x0B80, 0x0C00, "tamil"),
    (0x0E00, 0x0E80, "thai"), (0x10A0, 0x1100, "georgian"), (0x1100, 0x1200, "hangul"), (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"),
    (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"), (0xF900, 0xFB00, "han"), (0x20000, 0x32000, "han"),
]


LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
SCRIPT_NAMES = sorted({name for _, _, name in SCRIPTS}) + ["other"]
SCRIPT = np.full(0x110000, len(SCRIPT_NAMES) - 1, "u1")
for _low, _high, _name in SCRIPTS:
    SCRIPT[_low:_high] = SCRIPT_NAMES.index(_name)


def pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in pieces of at most `size` characters that end between words: after the last character that is no letter and no mark. A run without one is cut at `size`."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end > at and (text[end - 1].isalpha() or unicodedata.category(text[end - 1])[0] == "M" or unicodedata.category(text[end])[0] == "M"):
            end -= 1
        end = end if end > at else at + size
        yield text[at:end]
        at = end
    yield text[at:]


class Words:
    """The words (runs of letters, lower-cased, composed) of a piece of a text, as arrays: first position, length, script of the first letter; `chars`, how long the piece is then."""

    def __init__(self, text: str):
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        self.chars = len(text)
        codes = np.frombuffer(("\0" + text + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        letter = LETTER[codes]
        self.letters = np.where(letter, codes, 0).astype("u4")
        self.letter = letter
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        self.start = np.nonzero(first)[0]
        self.word = np.cumsum(first) - 1
        self.size = np.bincount(self.word[letter], minlength=len(self.start))
        self.script = SCRIPT[codes[self.start]]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cell, word) of each character n-gram, n = 2 to 4; what is no letter marks the ends of words and stands at the ends of a gram only."""
        x, on, word = self.letters, self.letter, self.word
        h, inner = x, None
        for n in (2, 3, 4):
            h = h[:-1] * np.uint32(0x9E3779B1) + x[n - 1 :]
            last = on[n - 1 :]
            if n == 2:
                fine, inner = on[:-1] | last, on[1:]
                owner = np.where(on[:-1], word[:-1], word[1:])
            else:
                inner = inner[: len(last)] if n == 3 else inner[: len(last)] & on[2 : 2 + len(last)]
                fine, owner = inner, word[1 : 1 + len(last)]
            yield _cell(h[fine], n), owner[fine]


def _cell(h: np.ndarray, n: int) -> np.ndarray:
    h = (h ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(16)


def fit(docs: DataFrame, sample: int = 12_000, smooth: float = 0.5) -> dict:
    """A model from the whole texts of about `sample` labelled rows (text and lang not null; all, if no more), taken by a hash of the id.

    Counts are summed on the executors into languages * 65,536 cells at most, which is what reaches the driver.
    """
    picked = sampled(docs.filter("text is not null and lang is not null"), sample, 3, "doc_id").select("text", "lang")

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in slices(parts):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                row = grams.setdefault(lang, np.zeros(CELLS + len(SCRIPT_NAMES), "i8"))
                for piece in pieces(text):
                    words = Words(piece)
                    for cell, _ in words.grams():
                        row[:CELLS] += np.bincount(cell, minlength=CELLS)
                    row[CELLS:] += np.bincount(words.script, minlength=len(SCRIPT_NAMES))
        for lang, row in grams.items():
            some = np.nonzero(row)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(row[some], pa.int64())], names=["lang", "cell", "n"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = picked.repartition(parts).mapInArrow(counted, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), CELLS + len(SCRIPT_NAMES)))
    counts[np.searchsorted(langs, got["lang"].to_numpy(str)) if langs else [], got["cell"].to_numpy("i8")] = got["n"].to_numpy("f8")
    grams, scripts = counts[:, :CELLS], counts[:, CELLS:]
    table = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * CELLS)).T
    shown = scripts >= np.maximum(1, 0.01 * scripts.sum(axis=1, keepdims=True))
    return {"langs": langs, "table": table.astype("f4"), "scripts": shown}


class Labels(NamedTuple):
    """A text's language, its share of the letters, and each word's language number, first position and length."""

    lang: str
    share: float
    path: np.ndarray
    start: np.ndarray
    size: np.ndarray


class Labeller:
    """Labels texts; holds nothing but the model."""

    def __init__(self, model: dict, penalty: float = 20.0, cap: float = 8.0):
        self.langs, self.table, self.scripts = model["langs"], model["table"], model["scripts"]
        self.penalty, self.cap = penalty, cap

    def scores(self, words: Words) -> np.ndarray:
        """Words by languages, 0 for a word's best; languages that don't write the word's script get the cap, unless none does."""
        s = np.zeros((len(words.start), len(self.langs)))
        for cell, word in words.grams():
            if len(word):
                total = np.cumsum(self.table[cell], axis=0, dtype="f8")  # grams come in the words' order
                at = np.nonzero(np.diff(word))[0]
                here = np.append(word[at], word[-1])
                s[here] += np.diff(total[np.append(at, len(word) - 1)], axis=0, prepend=0)
        able = self.scripts[:, words.script].T
        out = ~able & able.any(axis=1, keepdims=True)
        s[out] = -1e9
        return np.maximum(s - s.max(axis=1, keepdims=True), -self.cap)  # one word can't outweigh a span

    def fitting(self, words: Words) -> int:
        """The letters in words that some language fits: its mean n-gram there is likelier than an even draw of cells."""
        s, n = np.zeros((len(words.start), len(self.langs))), np.zeros(len(words.start))
        for cell, word in words.grams():
            np.add.at(s, word, self.table[cell])
            n += np.bincount(word, minlength=len(n))
        return int(words.size[s.max(axis=1) > -np.log(CELLS) * n].sum())

    def told(self, text: str | None, least: float) -> bool:
        """Whether a text has letters and is no word salad: one language has that share of them, or most stand in words that fit a language. Without languages nothing is salad."""
        if not self.langs:
            return any(c.isalpha() for c in text or "")
        found = self.label(text)
        if not len(found.start):
            return False
        return found.share >= least or 2 * sum(self.fitting(Words(p)) for p in pieces(text)) >= found.size.sum()

    def label(self, text: str | None) -> Labels:
        """The language of each word and of the text; `und` without letters or languages."""
        parts, start, size, chars = [], [], [], 0
        for piece in pieces(text or "") if self.langs else ():
            words = Words(piece)
            if len(words.start):
                parts.append(self.scores(words))
                start.append(words.start - 1 + chars)
                size.append(words.size)
            chars += words.chars
        if not parts:
            return Labels("und", 0.0, *(np.zeros(0, int),) * 3)
        path, start, size = self._viterbi(parts), np.concatenate(start), np.concatenate(size)
        weight = np.bincount(path, weights=size, minlength=len(self.langs))
        total = sum(s.sum(axis=0) for s in parts)
        best = max(range(len(self.langs)), key=lambda i: (weight[i], total[i], -i))
        return Labels(self.langs[best], float(weight[best] / weight.sum()), path, start, size)

    def _viterbi(self, parts: list[np.ndarray]) -> np.ndarray:
        """Best path over the words of all parts. If no other language gains more than half the penalty on any stretch, the best single language is that path: a path of k switches has at most k + 1 stretches in others."""
        langs, words = len(self.langs), sum(map(len, parts))
        main = int(sum(s.sum(axis=0) for s in parts).argmax())
        run, low, most = np.zeros(langs), np.zeros(langs), 0.0
        for s in parts:
            gain = run + np.cumsum(s - s[:, main : main + 1], axis=0)
            lows = np.minimum.accumulate(np.vstack([low, gain]), axis=0)
            most = max(most, float((gain - lows[:-1]).max()))
            run, low = gain[-1], lows[-1]
        if most * 2 <= self.penalty:
            return np.full(words, main)
        back, span, value, k = np.zeros((words, langs), "i2"), range(langs), [0.0] * langs, 0
        for s in parts:
            for row in s.tolist():
                if k:
                    top = max(span, key=value.__getitem__)
                    jump = value[top] - self.penalty
                    back[k] = [i if value[i] >= jump else top for i in span]
                    value = [(v if v >= jump else jump) + x for v, x in zip(value, row)]
                else:
                    value = row
                k += 1
        path = np.empty(words, int)
        now = max(span, key=value.__getitem__)
        for k in range(words - 1, -1, -1):
            path[k] = now
            now = back[k, now]
        return path

    def spans(self, found: Labels) -> list[tuple[int, int, str]]:
        """(first letter, past the last letter, language) of each span, in code points of the lower-cased, composed text."""
        path = found.path
        if not len(path):
            return []
        first = np.nonzero(np.diff(path, prepend=-1))[0]
        last = np.append(first[1:], len(path)) - 1
        return [(int(found.start[a]), int(found.start[b] + found.size[b]), self.langs[path[a]]) for a, b in zip(first, last)]


def identify(docs: DataFrame, model: dict, with_spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every row, whole texts; only doc_id and text are read.

    score: the share of letters in spans of the predicted language. `und` and 0 where the text is null,
    empty or has no letter (or nothing was learned), without spans. Ties go to the higher word score, then
    the smaller name. Repeated ids are rows of their own; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages * 65,536 floats

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        for batch in slices(parts):
            lang, score, spans = [], [], []
            for text in batch.column("text").to_pylist():
                found = labeller.label(text)
                lang.append(found.lang)
                score.append(found.share)
                if with_spans:
                    spans.append([{"first": x, "past": y, "lang": z} for x, y, z in labeller.spans(found)])
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", *["spans"] * with_spans])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<first:int,past:int,lang:string>>" * with_spans
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: dict, least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns, with letters, but for word salad: no language has that share of letters in its spans, and most letters are in
    words that fit none. A clean mix of languages stays, and so do all texts with letters if nothing could be learned. No exchange."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        for batch in slices(parts):
            yield batch.filter(pa.array([labeller.told(text, least) for text in batch.column(at).to_pylist()], pa.bool_()))

    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(doc_id, folds: int = 3, fold: int = 1):
    return crc_mod(doc_id, folds) == fold
