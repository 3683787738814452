"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; filters of `WIDTH` bytes slide over all of them; each filter's largest
answer in a chunk is kept (chunks of `CHUNK` starts, each overlapping the next by half, from the first byte
to the last), and a linear layer on these maxima gives the chunk's logit. The mean and the largest logit of
a document's chunks are combined into one probability.

As embedding and filters are linear, a filter's answer is a sum of WIDTH looked-up rows, one table a place;
gradients reach embedding and filters through the same tables. The network is trained on chunks drawn evenly
from labelled documents (a bounded number, a parameter), the combination on whole documents kept apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sampled, slices

WIDTH, CHUNK, HALF, PAD = 6, 256, 128, 256
FILTERS, DIM = 16, 8
#: Bytes of a text that are convolved at a time, a multiple of HALF.
STEP = 1 << 15


def byte_ids(text: str | None) -> np.ndarray:
    """Bytes of the text and WIDTH - 1 pads, so that every byte starts a window; an empty or null text has one window, of pads."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    x = np.full(max(len(raw), 1) + WIDTH - 1, PAD, "i8")
    x[: len(raw)] = np.frombuffer(raw, "u1")
    return x


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (PAD + 1, DIM))
        self.filters = r.normal(0, 1 / math.sqrt(WIDTH * DIM), (WIDTH, DIM, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = r.normal(0, 0.3, FILTERS)
        self.shift = np.zeros(1)
        self.tables()

    def tables(self) -> None:
        self.table = np.einsum("bd,kdf->kbf", self.embed, self.filters).astype("f4")

    def answers(self, x: np.ndarray) -> np.ndarray:
        """Filters' answers for each window of x (..., bytes)."""
        n = x.shape[-1] - WIDTH + 1
        a = self.table[0].take(x[..., :n], axis=0)
        for k in range(1, WIDTH):
            a += self.table[k].take(x[..., k : k + n], axis=0)
        return a

    def logits(self, text: str | None) -> np.ndarray:
        """One logit a chunk. A text of up to HALF windows is one chunk."""
        x, tops = byte_ids(text), []
        n = len(x) - WIDTH + 1
        for at in range(0, n, STEP):
            a = self.answers(x[at : min(at + STEP, n) + WIDTH - 1])
            tops.append(np.maximum.reduceat(a, np.arange(0, len(a), HALF), axis=0))
        halves = np.concatenate(tops)
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        return np.maximum(chunks + self.bias, 0) @ self.out + self.shift[0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of chunks x (n, CHUNK + WIDTH - 1) with labels y, and its gradients for the five parameters."""
        a = self.answers(x)
        best = a.argmax(axis=1)
        top = np.take_along_axis(a, best[:, None, :], axis=1)[:, 0] + self.bias
        h = np.maximum(top, 0)
        z = h @ self.out + self.shift[0]
        p = 1 / (1 + np.exp(-z))
        d = (p - y) / len(y)
        dh = d[:, None] * self.out * (top > 0)
        row, col = np.nonzero(dh)
        dt = np.zeros((WIDTH, PAD + 1, FILTERS))
        for k in range(WIDTH):
            np.add.at(dt[k], (x[row, best[row, col] + k], col), dh[row, col])
        loss = float(np.mean(np.logaddexp(0, z) - y * z))
        return loss, [np.einsum("kbf,kdf->bd", dt, self.filters), np.einsum("bd,kbf->kdf", self.embed, dt), dh.sum(0), h.T @ d, d.sum(keepdims=True)]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 1200, size: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Network:
        """Adam over `steps` batches, half of each of either class."""
        r = np.random.default_rng(11)
        sides = [np.nonzero(y == v)[0] for v in (0, 1)]
        params = [self.embed, self.filters, self.bias, self.out, self.shift]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            at = np.concatenate([r.choice(s, size // 2) for s in sides])
            _, grads = self.gradients(x[at], y[at])
            for p, g, a, b in zip(params, grads, m, v):
                g = g + decay * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (1 - t / (steps + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            self.tables()
        return self


def combined(logits: np.ndarray) -> tuple[float, float]:
    return float(logits.mean()), float(logits.max())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and bias of a logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def _drawn(text: str | None, chunks: int) -> list[bytes]:
    """At most `chunks` chunks of a text, as 16-bit ids, spread evenly from its start to its end."""
    x = byte_ids(text).astype("<u2")
    need = CHUNK + WIDTH - 1
    if len(x) <= need:
        return [np.pad(x, (0, need - len(x)), constant_values=PAD).tobytes()]
    last = len(x) - need
    return [x[at : at + need].tobytes() for at in sorted({round(last * i / max(chunks - 1, 1)) for i in range(chunks)})]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, chunks: int = 4) -> dict | None:
    """A model from about `sample` labelled rows (all, if no more), by a hash of the id, of which one in three fits the combination on
    whole texts. None without both classes. The driver gets `chunks` chunks of 261 ids a row at most, and two numbers for each whole text."""
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    marked = sampled(marked, sample, 31, "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marked, "doc_id").select("doc_id", "text", "quality")
    apart = F.pmod(F.xxhash64(F.lit(37), "doc_id"), F.lit(3)) == 0

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            got = [_drawn(t, chunks) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(got, pa.list_(pa.binary()))], names=["doc_id", "quality", "x"])

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            got = [combined(network.logits(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.filter(~apart).mapInArrow(draw, "doc_id long, quality int, x array<binary>").toPandas().sort_values("doc_id", ignore_index=True)
    if got["quality"].nunique() < 2:
        return None
    y = np.repeat(got["quality"].to_numpy("f8"), got["x"].map(len))
    x = np.frombuffer(b"".join(b for bs in got["x"] for b in bs), "<u2").reshape(len(y), -1).astype("i8")
    network = Network().train(x, y)
    got = rows.filter(apart).mapInArrow(whole, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", ignore_index=True)
    if got["quality"].nunique() < 2:
        return {"network": network, "weights": np.array([1.0, 0.0, 0.0])}
    return {"network": network, "weights": logistic(np.stack(got["x"].to_numpy()), got["quality"].to_numpy("f8"))}


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every row, whole texts; a null text scores as an empty one. 0 everywhere if nothing could be learned.

    Repeated rows are rows of their own and score alike; an empty table gives an empty one; only doc_id and
    text are read. A text is convolved in pieces, so a long one needs little more than its bytes.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 30,000 floats

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(parts):
            score = np.zeros(batch.num_rows)
            if m and batch.num_rows:
                x = np.array([combined(m["network"].logits(t)) for t in batch.column("text").to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(x @ m["weights"][:2] + m["weights"][2], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id, folds: int = 5, fold: int = 0):
    return crc_mod(doc_id, folds) == fold
