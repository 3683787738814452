"""Batch scoring of tensors: a scorer is any function from (n, ...) float arrays to n scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .graph import Graph, with_moments

Scorer = Callable[[np.ndarray], np.ndarray]

#: The SNV network. (kind, size, filters or units); convolutions are valid after the first.
SNV_LAYERS = [
    ("conv", (1, 1), 64), ("conv", (1, 5), 64), ("conv", (1, 3), 64), ("conv", (1, 3), 64), ("pool", (3, 1), 0), ("conv", (1, 3), 32),
    ("pool", (3, 1), 0), ("conv", (3, 1), 64), ("conv", (3, 1), 32), ("flatten", (), 0), ("dense", (), 256), ("dense", (), 128), ("dense", (), 64), ("dense", (), 1),
]


def shapes(layers=SNV_LAYERS, shape: tuple[int, ...] = (100, 70, 5)) -> list[tuple[int, ...]]:
    out = []
    for kind, size, n in layers:
        if kind == "conv":
            shape = (shape[0] - size[0] + 1, shape[1] - size[1] + 1, n)
        elif kind == "pool":
            shape = (shape[0] // size[0], shape[1] // size[1], shape[2])
        else:
            shape = (int(np.prod(shape)),) if kind == "flatten" else (n,)
        out.append(shape)
    return out


class Network:
    """A numpy forward pass. Weights: for each layer a dict of w, b and, but for the last, gamma, beta, mean, var."""

    def __init__(self, weights: list[dict | None], layers=SNV_LAYERS):
        self.weights, self.layers = weights, layers

    @classmethod
    def seeded(cls, seed: int = 0, layers=SNV_LAYERS, shape: tuple[int, ...] = (100, 70, 5)) -> Network:
        """Random weights, for tests: none are public."""
        rng, out = np.random.default_rng(seed), []
        for (kind, size, n), to in zip(layers, shapes(layers, shape)):
            if kind in ("conv", "dense"):
                fan = (*size, shape[-1]) if kind == "conv" else shape
                out.append({"w": rng.normal(0, (2 / np.prod(fan)) ** 0.5, (*fan, n)).astype("f4"), "b": np.zeros(n, "f4"), "gamma": np.ones(n, "f4"), "beta": np.zeros(n, "f4"), "mean": np.zeros(n, "f4"), "var": np.ones(n, "f4")})
            else:
                out.append(None)
            shape = to
        return cls(out, layers)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for (kind, size, _), w in zip(self.layers[:-1], self.weights):
            x = _layer(kind, size, w, x)
        x = x @ self.weights[-1]["w"] + self.weights[-1]["b"]
        return 1 / (1 + np.exp(-x[:, 0]))


def normalised(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Channel by channel."""
    return (x - mean) / std


class Normalised:
    """A scorer that sees tensors normalised channel by channel."""

    def __init__(self, scorer: Scorer, mean: np.ndarray, std: np.ndarray):
        self.scorer, self.mean, self.std = scorer, mean, std

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.scorer(normalised(x, self.mean, self.std))


def save_weights(network: Network, path: str) -> None:
    """An .npz with arrays named layer.weight, such as 0.w or 0.gamma."""
    np.savez(path, **{f"{i}.{k}": v for i, w in enumerate(network.weights) for k, v in (w or {}).items()})


def load_network(weights: str, layers: str | None = None, mean: str | None = None, std: str | None = None) -> Scorer:
    """A scorer from files: weights (.npz) and architecture (JSON), any graph of known layers, with arrays named <layer>/<number>; without one the
    SNV network, with arrays as save_weights names them. mean, std: of each channel (.npy)."""
    if layers:
        network = Graph.load(layers, weights)
    else:
        with np.load(weights) as held:
            known = {k: held[k] for k in held.files}
        parts = [{k.partition(".")[2]: v for k, v in known.items() if k.partition(".")[0] == str(i)} or None for i in range(len(SNV_LAYERS))]
        if any((kind in ("conv", "dense")) != (w is not None) for (kind, _, _), w in zip(SNV_LAYERS, parts)):
            raise ValueError(f"{weights} are not the weights of the SNV network; give the architecture too")
        network = Network(parts, SNV_LAYERS)
    return Normalised(network, np.load(mean), np.load(std)) if mean and std else network


def adapted(network: Network, x: np.ndarray, seed: int = 0, limit: int = 1000) -> Network:
    """Batch-norm statistics taken from at most `limit` of the sites to be scored instead of from training."""
    some = x[np.random.default_rng(seed).permutation(len(x))[:limit]]
    out = [dict(w) if w else None for w in network.weights]
    for (kind, size, _), w in zip(network.layers[:-1], out):
        if w is not None:
            seen = _layer(kind, size, w, some, norm=False)
            axes = tuple(range(seen.ndim - 1))
            w["mean"], w["var"] = seen.mean(axis=axes), seen.var(axis=axes)
        some = _layer(kind, size, w, some)
    return Network(out, network.layers)


def _layer(kind: str, size, w, x: np.ndarray, norm: bool = True) -> np.ndarray:
    if kind == "conv":
        x = np.einsum("nrcxhw,hwxf->nrcf", np.lib.stride_tricks.sliding_window_view(x, size, axis=(1, 2)), w["w"], optimize=True) + w["b"]
    elif kind == "pool":
        return x[:, : x.shape[1] // size[0] * size[0]].reshape(len(x), -1, size[0], *x.shape[2:]).mean(axis=2)
    elif kind == "flatten":
        return x.reshape(len(x), -1)
    else:
        x = x @ w["w"] + w["b"]
    x = np.maximum(x, 0)
    return w["gamma"] * (x - w["mean"]) / np.sqrt(w["var"] + 0.001) + w["beta"] if norm else x


def refreshed(scorer: Scorer, tensors: DataFrame, shape: tuple[int, ...], sites: int = 1000) -> Scorer:
    """A graph, normalised or not, with batch-norm statistics of the sites to be scored."""
    if isinstance(scorer, Normalised):
        inner, mean, std = scorer.scorer, scorer.mean, scorer.std
        if isinstance(inner, Graph):
            return Normalised(with_moments(inner, tensors, shape, sites, prepare=lambda x: normalised(x, mean, std).astype("f4")), mean, std)
    elif isinstance(scorer, Graph):
        return with_moments(scorer, tensors, shape, sites)
    raise ValueError("statistics can be taken anew for networks that are given with their architecture")


def score(tensors: DataFrame, scorer: Scorer, shape: tuple[int, ...], batch: int = 64) -> DataFrame:
    """(chrom, pos, pred_true): the scorer runs over batches of sites, broadcast once to the executors."""
    held = tensors.sparkSession.sparkContext.broadcast(scorer)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                x = np.stack(some["data"].to_numpy()).reshape(len(some), *shape)
                yield pd.DataFrame({"chrom": some["chrom"], "pos": some["pos"], "pred_true": np.asarray(held.value(x), "f8")})

    return tensors.mapInPandas(run, "chrom string, pos long, pred_true double")


def scored(spark: SparkSession, scorer: Scorer, shape: tuple[int, ...]):
    """What tensors() makes of its images instead of data: pred_true, by a scorer that is broadcast once to the executors."""
    held = spark.sparkContext.broadcast(scorer)
    return lambda images: [np.asarray(held.value(images.reshape(-1, *shape)), "f8")], "pred_true double"
