"""Networks as graphs of layers, in numpy: read from the JSON that training libraries write, run over tiles of sites.

Layers run in topological order and may branch, meet (add, concatenate) and repeat; what isn't known here is
refused by name, so no network is ever run as another one. A convolution is one matrix product for each
place of its window. Batch-norm statistics can be taken from the sites to be scored (`with_moments`), and
batch-norm scales and shifts can be moved to make scores surer (`sharpened`); both add up over executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, saved


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    config: dict
    inputs: tuple[str, ...]


#: Settings that change what a layer computes, with the only values that are carried out.
ONLY = {"data_format": (None, "channels_last"), "dilation_rate": (None, 1, [1, 1]), "groups": (None, 1), "depth_multiplier": (None, 1), "ragged": (None, False), "sparse": (None, False)}
ACTIVATIONS = {
    "linear": lambda x: x, "relu": lambda x: np.maximum(x, 0), "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -80, 80))), "tanh": np.tanh,
    "softmax": lambda x: (e := np.exp(x - x.max(axis=-1, keepdims=True))) / e.sum(axis=-1, keepdims=True),
}
#: Layers that only act while training, or hand on what they get.
PASSING = {"InputLayer", "Dropout", "SpatialDropout2D", "GaussianNoise", "ActivityRegularization"}
KNOWN = PASSING | {"Conv2D", "Dense", "Activation", "ReLU", "BatchNormalization", "AveragePooling2D", "MaxPooling2D", "GlobalAveragePooling2D", "GlobalMaxPooling2D", "Flatten", "Concatenate", "Add", "ZeroPadding2D"}


def _checked(kind: str, name: str, c: dict) -> None:
    if kind not in KNOWN:
        raise ValueError(f"layer {name} is a {kind}, which is not known here")
    for key, values in ONLY.items():
        if c.get(key) not in values:
            raise ValueError(f"layer {name} has {key}={c[key]!r}, which is not known here")
    activation = c.get("activation")
    if kind in ("Conv2D", "Dense", "Activation") and (activation or "linear") not in ACTIVATIONS:
        raise ValueError(f"layer {name} has the activation {activation!r}, which is not known here")
    if c.get("padding", "valid") not in ("valid", "same") and kind != "ZeroPadding2D":
        raise ValueError(f"layer {name} has padding={c['padding']!r}, which is not known here")
    if kind == "ReLU" and any(c.get(k) for k in ("max_value", "negative_slope", "threshold")):
        raise ValueError(f"layer {name} is a bounded or leaky ReLU, which is not known here")
    axis = c.get("axis", -1)
    if kind in ("BatchNormalization", "Concatenate") and (axis if isinstance(axis, int) else axis[0]) not in (-1, 3):
        raise ValueError(f"layer {name} works on axis {axis!r}; only the last is known here")


def _inbound(layer: dict) -> tuple[str, ...]:
    nodes = layer.get("inbound_nodes") or []
    if len(nodes) > 1:
        raise ValueError(f"layer {layer['name']} is used {len(nodes)} times; shared layers are not known here")
    out: list[str] = []

    def walk(x) -> None:
        """Older files nest [name, node, tensor, {}] lists, newer ones hold tensors with a keras_history."""
        if isinstance(x, dict):
            if "keras_history" in x.get("config", {}):
                out.append(x["config"]["keras_history"][0])
            else:
                for v in x.values():
                    walk(v)
        elif isinstance(x, list):
            if len(x) >= 3 and isinstance(x[0], str) and isinstance(x[1], int):
                out.append(x[0])
            else:
                for v in x:
                    walk(v)

    walk(nodes)
    return tuple(out)


def nodes_of(text: str) -> list[Node]:
    """The layers in an order in which each comes after its inputs. One input, one output."""
    whole = json.loads(text)
    kind, config = whole["class_name"], whole["config"]
    layers = config["layers"] if isinstance(config, dict) else config
    out: list[Node] = []
    if kind == "Sequential":
        for i, layer in enumerate(layers):
            name = layer["config"].get("name") or f"layer_{i}"
            out.append(Node(name, layer["class_name"], layer["config"], (out[-1].name,) if out else ()))
    elif kind in ("Model", "Functional"):
        waiting = [Node(x["config"].get("name") or x["name"], x["class_name"], x["config"], _inbound(x)) for x in layers]
        for side in ("input_layers", "output_layers"):
            ends = config[side]
            if not isinstance(ends[0], str) and len(ends) > 1:
                raise ValueError(f"the network has {len(ends)} {side}; one is known here")
        done: set[str] = set()
        while waiting:
            ready = [n for n in waiting if set(n.inputs) <= done]
            if not ready:
                raise ValueError("the layers' inputs go round in a circle or are missing")
            out += ready
            done |= {n.name for n in ready}
            waiting = [n for n in waiting if n.name not in done]
        last = config["output_layers"][0]
        last = last if isinstance(last, str) else last[0]
        at = next(i for i, n in enumerate(out) if n.name == last)
        out = [*out[:at], *out[at + 1 :], out[at]]
    else:
        raise ValueError(f"a network of the class {kind} is not known here")
    for n in out:
        _checked(n.kind, n.name, n.config)
    return out


def _pair(x) -> tuple[int, int]:
    return (x, x) if isinstance(x, int) else (x[0], x[1])


def _padded(x: np.ndarray, size, stride, same: bool, fill: float = 0.0) -> tuple[np.ndarray, tuple[int, int]]:
    """x with the margins that `same` asks for (the odd one below and to the right), and how much was put before."""
    if not same:
        return x, (0, 0)
    need = [max((-(-n // s) - 1) * s + k - n, 0) for n, k, s in zip(x.shape[1:3], size, stride)]
    before = (need[0] // 2, need[1] // 2)
    return np.pad(x, ((0, 0), *((b, n - b) for b, n in zip(before, need)), (0, 0)), constant_values=fill), before


def _places(x: np.ndarray, size, stride) -> Iterator[tuple[int, int, tuple]]:
    """For each place of a window, the slice of x that it sees over all positions."""
    rows, cols = ((n - k) // s + 1 for n, k, s in zip(x.shape[1:3], size, stride))
    for i in range(size[0]):
        for j in range(size[1]):
            yield i, j, (slice(None), slice(i, i + (rows - 1) * stride[0] + 1, stride[0]), slice(j, j + (cols - 1) * stride[1] + 1, stride[1]))


class Graph:
    """weights: for each layer's name its arrays in the training library's order: kernel and bias; or gamma, beta, mean and variance (without those that the layer hasn't). precision: of the sites; with f8 weights too, scores are in double precision."""

    def __init__(self, nodes: list[Node], weights: dict[str, list[np.ndarray]], precision: str = "f4"):
        self.nodes, self.weights, self.precision = nodes, weights, precision
        for n in nodes:
            want = {"Conv2D": 1 + n.config.get("use_bias", True), "Dense": 1 + n.config.get("use_bias", True), "BatchNormalization": 2 + n.config.get("scale", True) + n.config.get("center", True)}.get(n.kind, 0)
            if len(weights.get(n.name, ())) != want:
                raise ValueError(f"layer {n.name} takes {want} arrays of weights, not {len(weights.get(n.name, ()))}")
        if extra := set(weights) - {n.name for n in nodes}:
            raise ValueError(f"weights for layers that are not there: {sorted(extra)}")

    @classmethod
    def load(cls, architecture: str, weights: str) -> Graph:
        """From the JSON file and an .npz file with arrays named <layer>/<number>."""
        with np.load(weights) as held:
            named: dict[str, dict[int, np.ndarray]] = {}
            for key in held.files:
                layer, _, i = key.rpartition("/")
                if not layer or not i.isdigit():
                    raise ValueError(f"{weights}: arrays are named <layer>/<number>, not {key}")
                named.setdefault(layer, {})[int(i)] = held[key]
        return cls(nodes_of(Path(architecture).read_text()), {k: [v[i] for i in sorted(v)] for k, v in named.items()})

    def save(self, weights: str) -> None:
        np.savez(weights, **{f"{k}/{i}": a for k, arrays in self.weights.items() for i, a in enumerate(arrays)})

    @classmethod
    def seeded(cls, nodes: list[Node], shape: tuple[int, ...], seed: int = 0) -> Graph:
        """Random weights, for tests: none are public. Shapes come from a run over one site of zeros."""
        rng, weights = np.random.default_rng(seed), {}

        def make(n: Node, x: np.ndarray) -> None:
            c, width = n.config, x.shape[-1]
            if n.kind in ("Conv2D", "Dense"):
                fan = (*_pair(c["kernel_size"]), width) if n.kind == "Conv2D" else (width,)
                out = c["filters"] if n.kind == "Conv2D" else c["units"]
                weights[n.name] = [rng.normal(0, (2 / np.prod(fan)) ** 0.5, (*fan, out)).astype("f4"), rng.normal(0, 0.1, out).astype("f4")][: 1 + c.get("use_bias", True)]
            elif n.kind == "BatchNormalization":
                some = [rng.uniform(0.5, 1.5, width)] * c.get("scale", True) + [rng.normal(0, 0.1, width)] * c.get("center", True)
                weights[n.name] = [a.astype("f4") for a in (*some, rng.normal(0, 0.1, width), rng.uniform(0.5, 1.5, width))]

        bare = cls.__new__(cls)
        bare.nodes, bare.weights = nodes, weights
        bare.forward(np.zeros((1, *shape), "f4"), before=make)
        return cls(nodes, weights)

    def _norm(self, n: Node) -> tuple[np.ndarray, ...]:
        """gamma, beta, mean, variance."""
        own, c = list(self.weights[n.name]), n.config
        gamma = own.pop(0) if c.get("scale", True) else np.float32(1)
        beta = own.pop(0) if c.get("center", True) else np.float32(0)
        return gamma, beta, *own

    def forward(self, x: np.ndarray, until: str | None = None, before=None) -> dict[str, np.ndarray]:
        """Each layer's output; `until`: only up to that layer's input, kept as "". before(node, input) is called first."""
        made: dict[str, np.ndarray] = {}
        for n in self.nodes:
            ins = [made[i] for i in n.inputs] or [x]
            if n.name == until:
                return {"": ins[0]}
            if before:
                before(n, ins[0])
            made[n.name] = self._run(n, ins)
        return made

    def _run(self, n: Node, ins: list[np.ndarray]) -> np.ndarray:
        x, c, kind = ins[0], n.config, n.kind
        act = ACTIVATIONS[c.get("activation") or "linear"] if kind in ("Conv2D", "Dense", "Activation") else None
        if kind == "Conv2D":
            w, size, stride = self.weights[n.name], _pair(c["kernel_size"]), _pair(c.get("strides", 1))
            x, _ = _padded(x, size, stride, c.get("padding") == "same")
            out = sum(x[at] @ w[0][i, j] for i, j, at in _places(x, size, stride))
            return act(out + w[1] if len(w) > 1 else out)
        if kind == "Dense":
            w = self.weights[n.name]
            return act(x @ w[0] + w[1] if len(w) > 1 else x @ w[0])
        if kind in ("AveragePooling2D", "MaxPooling2D"):
            size, same = _pair(c.get("pool_size", 2)), c.get("padding") == "same"
            stride = _pair(c.get("strides") or size)
            top = kind == "MaxPooling2D"
            wide, _ = _padded(x, size, stride, same, -np.inf if top else 0.0)
            parts = [wide[at] for _, _, at in _places(wide, size, stride)]
            if top:
                return np.maximum.reduce(parts)
            ones, _ = _padded(np.ones((1, *x.shape[1:3], 1), x.dtype), size, stride, same)
            return sum(parts) / sum(ones[at] for _, _, at in _places(ones, size, stride))
        if kind == "BatchNormalization":
            gamma, beta, mean, var = self._norm(n)
            return gamma * (x - mean) / np.sqrt(var + np.float32(c.get("epsilon", 1e-3))) + beta
        if kind == "GlobalAveragePooling2D":
            return x.mean(axis=(1, 2))
        if kind == "GlobalMaxPooling2D":
            return x.max(axis=(1, 2))
        if kind == "Flatten":
            return x.reshape(len(x), -1)
        if kind == "Concatenate":
            return np.concatenate(ins, axis=-1)
        if kind == "Add":
            return sum(ins)
        if kind == "ZeroPadding2D":
            (a, b), (d, e) = ((p, p) if isinstance(p, int) else tuple(p) for p in (c["padding"] if not isinstance(c["padding"], int) else (c["padding"],) * 2))
            return np.pad(x, ((0, 0), (a, b), (d, e), (0, 0)))
        if kind == "ReLU":
            return np.maximum(x, 0)
        return act(x) if kind == "Activation" else x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One score a site: the only output, or the second of two classes."""
        out = self.forward(np.asarray(x, self.precision))[self.nodes[-1].name].reshape(len(x), -1)
        return out[:, 1 if out.shape[1] == 2 else 0]

    # -- gradients of the scores' entropy for scales and shifts

    def entropy(self, x: np.ndarray) -> tuple[float, int, dict[str, list[np.ndarray]]]:
        """Sum of the scores' entropies (bits), their number, and its gradients for gamma and beta of each batch norm. For one sigmoid output."""
        made = self.forward(x)
        p = made[self.nodes[-1].name].reshape(len(x), -1)
        if p.shape[1] != 1:
            raise ValueError("entropy is taken of networks with one output")
        q = np.clip(p, 1e-6, 1 - 1e-6)
        value = float(-(q * np.log2(q) + (1 - q) * np.log2(1 - q)).sum())
        back = {self.nodes[-1].name: (np.log2((1 - q) / q) * (p == q)).reshape(made[self.nodes[-1].name].shape)}
        grads: dict[str, list[np.ndarray]] = {}
        for n in reversed(self.nodes):
            dy = back.pop(n.name, None)
            if dy is None:
                continue
            ins = [made[i] for i in n.inputs] or [x]
            for name, dx in zip(n.inputs, self._back(n, ins, made[n.name], dy, grads)):
                back[name] = back[name] + dx if name in back else dx
        return value, len(p), grads

    def _back(self, n: Node, ins: list[np.ndarray], y: np.ndarray, dy: np.ndarray, grads: dict) -> list[np.ndarray]:
        x, c, kind = ins[0], n.config, n.kind
        if kind in ("Conv2D", "Dense", "Activation"):
            name = c.get("activation") or "linear"
            if name == "softmax":
                raise ValueError("no gradient goes through a softmax here")
            dy = dy * {"linear": 1.0, "relu": y > 0, "sigmoid": y * (1 - y), "tanh": 1 - y * y}[name]
        if kind == "Conv2D":
            size, stride = _pair(c["kernel_size"]), _pair(c.get("strides", 1))
            wide, (a, b) = _padded(x, size, stride, c.get("padding") == "same")
            dx = np.zeros_like(wide)
            for i, j, at in _places(wide, size, stride):
                dx[at] += dy @ self.weights[n.name][0][i, j].T
            return [dx[:, a : a + x.shape[1], b : b + x.shape[2]]]
        if kind == "Dense":
            return [dy @ self.weights[n.name][0].T]
        if kind in ("AveragePooling2D", "MaxPooling2D"):
            size, same = _pair(c.get("pool_size", 2)), c.get("padding") == "same"
            stride, top = _pair(c.get("strides") or size), kind == "MaxPooling2D"
            wide, (a, b) = _padded(x, size, stride, same, -np.inf if top else 0.0)
            dx, taken = np.zeros_like(wide), np.zeros(y.shape, bool)
            if not top:
                ones, _ = _padded(np.ones((1, *x.shape[1:3], 1), x.dtype), size, stride, same)
                dy = dy / sum(ones[at] for _, _, at in _places(ones, size, stride))
            for _, _, at in _places(wide, size, stride):
                if top:  # the first of equal largest ones gets it all
                    first = (wide[at] == y) & ~taken
                    taken |= first
                    dx[at] += dy * first
                else:
                    dx[at] += dy
            return [dx[:, a : a + x.shape[1], b : b + x.shape[2]]]
        if kind == "BatchNormalization":
            gamma, _, mean, var = self._norm(n)
            root = np.sqrt(var + np.float32(c.get("epsilon", 1e-3)))
            axes = tuple(range(x.ndim - 1))
            grads[n.name] = [(dy * (x - mean) / root).sum(axis=axes)] * c.get("scale", True) + [dy.sum(axis=axes)] * c.get("center", True)
            return [dy * gamma / root]
        if kind == "GlobalAveragePooling2D":
            return [np.broadcast_to(dy[:, None, None] / (x.shape[1] * x.shape[2]), x.shape)]
        if kind == "GlobalMaxPooling2D":
            top = x == y[:, None, None]
            return [dy[:, None, None] * top / top.sum(axis=(1, 2), keepdims=True)]
        if kind == "Flatten":
            return [dy.reshape(x.shape)]
        if kind == "Concatenate":
            return np.split(dy, np.cumsum([i.shape[-1] for i in ins])[:-1], axis=-1)
        if kind == "Add":
            return [dy] * len(ins)
        if kind == "ZeroPadding2D":
            (a, _), (d, _) = ((p, p) if isinstance(p, int) else tuple(p) for p in (c["padding"] if not isinstance(c["padding"], int) else (c["padding"],) * 2))
            return [dy[:, a : a + x.shape[1], d : d + x.shape[2]]]
        return [dy * (x > 0)] if kind == "ReLU" else [dy]


# -- over executors


def _sample(tensors: DataFrame, sites: int, seed: int) -> DataFrame:
    """The `sites` sites whose hash is smallest, saved."""
    picked = tensors.orderBy(F.xxhash64(F.lit(seed), "chrom", "pos"), "chrom", "pos").limit(sites)
    return saved(picked.select("data"), "adapting")


def _arrays(pdf: pd.DataFrame, shape: tuple[int, ...], batch: int) -> Iterator[np.ndarray]:
    for at in range(0, len(pdf), batch):
        some = pdf["data"].iloc[at : at + batch]
        yield np.stack(some.to_numpy()).reshape(len(some), *shape).astype("f4")


def with_moments(graph: Graph, tensors: DataFrame, shape: tuple[int, ...], sites: int = 1000, seed: int = 0, prepare=None, batch: int = 64) -> Graph:
    """The graph with batch-norm means and variances of (at most `sites` of) the sites to be scored, layer by layer, each seen through the new statistics of those before it.

    A task hands on the count, mean and sum of squared differences of each channel; two such are merged
    exactly, so the result doesn't depend on how sites are dealt. prepare: what is done to a batch first.
    """
    held = _sample(tensors, sites, seed)
    for n in [n for n in graph.nodes if n.kind == "BatchNormalization"]:
        now = graph

        def run(parts: Iterator[pd.DataFrame], n=n, now=now) -> Iterator[pd.DataFrame]:
            count, mean, square = 0, 0.0, 0.0
            for pdf in parts:
                for x in _arrays(pdf, shape, batch):
                    x = now.forward(prepare(x) if prepare else x, until=n.name)[""].astype("f8")
                    x = x.reshape(-1, x.shape[-1])
                    count, mean, square = merged((count, mean, square), (len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)))
            if count:
                yield pd.DataFrame({"n": [count], "mean": [mean], "square": [square]})

        got = held.mapInPandas(run, "n long, mean array<double>, square array<double>").collect()  # a row a task, of a layer's channels
        if not got:
            break
        count, mean, square = 0, 0.0, 0.0
        for r in got:
            count, mean, square = merged((count, mean, square), (r["n"], np.array(r["mean"]), np.array(r["square"])))
        own = graph.weights[n.name][:-2]
        graph = Graph(graph.nodes, graph.weights | {n.name: [*own, mean.astype("f4"), (square / count).astype("f4")]}, graph.precision)
    forget(held)
    return graph


def merged(a: tuple, b: tuple) -> tuple:
    """(count, mean, sum of squared differences) of two sets together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)


def sharpened(graph: Graph, tensors: DataFrame, shape: tuple[int, ...], steps: int = 10, rate: float = 0.05, sites: int = 1000, seed: int = 0, prepare=None, batch: int = 32) -> tuple[Graph, list[float]]:
    """The graph after `steps` of entropy minimisation over (at most `sites` of) the sites to be scored, and the mean entropy before each step and at the end.

    Only scales and shifts of batch norms move, down their gradients' sum over all tasks. A step that would
    raise the entropy is halved instead.
    """
    held = _sample(tensors, sites, seed)

    def summed(now: Graph) -> tuple[float, dict[str, list[np.ndarray]]]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            value, count, total = 0.0, 0, {}
            for pdf in parts:
                for x in _arrays(pdf, shape, batch):
                    v, n, grads = now.entropy(prepare(x) if prepare else x)
                    value, count = value + v, count + n
                    for k, arrays in grads.items():
                        total[k] = [s + a for s, a in zip(total[k], arrays)] if k in total else arrays
            if count:
                flat = np.concatenate([a.astype("f8") for k in sorted(total) for a in total[k]]) if total else np.zeros(0)
                yield pd.DataFrame({"value": [value], "n": [count], "grad": [flat]})

        got = held.mapInPandas(run, "value double, n long, grad array<double>").collect()  # a row a task, of all scales and shifts
        n = sum(r["n"] for r in got) or 1
        flat = sum(np.array(r["grad"]) for r in got) / n if got else np.zeros(0)
        grads, at = {}, 0
        for node in sorted((x for x in now.nodes if x.kind == "BatchNormalization"), key=lambda x: x.name):
            grads[node.name] = []
            for a in now.weights[node.name][:-2]:
                grads[node.name].append(flat[at : at + len(a)] if got else np.zeros(len(a)))
                at += len(a)
        return sum(r["value"] for r in got) / n, grads

    seen = []
    value, grads = summed(graph)
    for _ in range(steps):
        seen.append(value)
        moved = {k: [*((a - rate * g).astype("f4") for a, g in zip(graph.weights[k], gs)), *graph.weights[k][-2:]] for k, gs in grads.items()}
        trial = Graph(graph.nodes, graph.weights | moved, graph.precision)
        new, new_grads = summed(trial)
        if new <= value:
            graph, value, grads = trial, new, new_grads
        else:
            rate /= 2
    forget(held)
    return graph, [*seen, value]

