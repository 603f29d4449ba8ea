"""Training of layered systems on Spark.

A round sends the parameters (a few numbers) to all tasks; each takes update steps on minibatches of its own rows and
returns its parameters; Spark averages them, weighted by rows. With one round per update, this is plain gradient
descent over all rows; with more updates per round, local steps save jobs. Rows never leave their tasks, of which each
keeps a reservoir of a size that the schedule sets; `epochs` trains on all rows without one. Every draw comes from a seed, the round and the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.functions.registry import register
from lumenframe.operators.system import System, Units, forward, initialize, measure


@dataclass(frozen=True)
class Schedule:
    updates: int = 1000
    rounds: int = 5
    minibatch: int = 100
    rate: float = 0.1
    algorithm: str = "bprop"
    seed: int = 0
    noise: tuple[str | None, float] = (None, 0.0)
    options: dict[str, float] = field(default_factory=dict)
    #: Objective that is looked at after each round; with keep_best, the best parameters are kept.
    objective: str | None = "error"
    keep_best: bool = True
    #: Updates that a minibatch is used for before another is drawn.
    interval: int = 1
    #: Rows that a task keeps to draw its minibatches from, each with equal probability; epochs.fit_epochs takes all rows.
    reservoir: int = 20_000

    @classmethod
    def from_settings(cls, settings: dict[str, object], **given) -> Schedule:
        """A schedule from the settings of a system file; settings that have no field here become options."""
        named = {SETTINGS[k]: v for k, v in settings.items() if k in SETTINGS}
        if named.get("algorithm") in ("cd", "cdk"):
            named |= {"algorithm": "contrastive", "objective": None}
        rest = {OPTIONS.get(k, k): float(v) for k, v in settings.items() if k not in SETTINGS and isinstance(v, (bool, int, float))}
        return cls(**(named | {"options": rest} | given))


#: Names of settings in system files.
SETTINGS = {
    "algorithm": "algorithm", "updates": "updates", "update_rate": "rate", "minibatch_size": "minibatch", "minibatch_update_interval": "interval",
    "tracker_obj_function": "objective", "tracker_obj_keep_optimum": "keep_best",
}
OPTIONS = {
    "update_factor_weights": "weights_factor", "update_factor_hbias": "hbias_factor", "update_factor_vbias": "vbias_factor",
    "update_cd_sampling_steps": "steps", "update_cd_sampling_iterations": "iterations",
}


# ---------------------------------------------------------------- numpy steps of one task


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _up(source: Units, target: Units, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Expectation of the target layer."""
    z = target.bias + (x / np.exp(source.lvar / 2) if source.kind == "gauss" else x) @ w
    return _logistic(z) if target.kind == "sigmoid" else z


def gradients(system: System, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Update directions (bias by layer after the first, weights by link) of back-propagated output errors.

    Biases get the mean of the layer's error, weights the product with the layer below over its number of cells.
    """
    values = [x]
    for k, w in enumerate(system.weights):
        values.append(_up(system.layers[k], system.layers[k + 1], w, values[-1]))
    error = values[-1] - y
    biases: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    for k in range(len(system.weights) - 1, -1, -1):
        biases.append(-error.mean(axis=0))
        weights.append(-(values[k].T @ error) / values[k].size)
        if k:
            pre = system.layers[k].bias + values[k - 1] @ system.weights[k - 1]
            slope = _logistic(pre) * (1 - _logistic(pre)) if system.layers[k].kind == "sigmoid" else 1.0
            error = (error @ system.weights[k].T) * slope
    return biases[::-1], weights[::-1]


def _moved(system: System, biases: list[np.ndarray], weights: list[np.ndarray]) -> System:
    layers = (system.layers[0], *(replace(u, bias=u.bias + b) for u, b in zip(system.layers[1:], biases, strict=True)))
    return replace(system, layers=layers, weights=tuple(w + d * a for w, d, a in zip(system.weights, weights, system.adjacency, strict=True)))


@register("trainer", "bprop")
class Bprop:
    """Gradient descent with a fixed rate."""

    def __init__(self, schedule: Schedule, rng: np.random.Generator):
        self.rate = schedule.options.get("bprop_rate", schedule.rate)

    def step(self, system: System, x: np.ndarray, y: np.ndarray) -> System:
        b, w = gradients(system, x, y)
        return _moved(system, [self.rate * g for g in b], [self.rate * g for g in w])


@register("trainer", "rprop")
class Rprop:
    """Resilient steps: sizes grow while a gradient keeps its sign and shrink when it turns."""

    def __init__(self, schedule: Schedule, rng: np.random.Generator):
        o = schedule.options
        self.shrink, self.keep, self.grow = o.get("shrink", 0.5), 1.0, o.get("grow", 1.2)
        self.start, self.least, self.most = o.get("init_rate", 0.001), o.get("min_factor", 1e-6), o.get("max_factor", 50.0)
        self.signs: list[np.ndarray] | None = None
        self.sizes: list[np.ndarray] = []

    def step(self, system: System, x: np.ndarray, y: np.ndarray) -> System:
        b, w = gradients(system, x, y)
        signs = [np.sign(g) for g in (*b, *w)]
        if self.signs is None:
            self.signs, self.sizes = signs, [np.full(s.shape, self.start) for s in signs]
        for k, (old, new) in enumerate(zip(self.signs, signs, strict=True)):
            turn = old * new
            factor = np.where(turn > 0, self.grow, np.where(turn < 0, self.shrink, self.keep))
            self.sizes[k] = np.clip(self.sizes[k] * factor, self.least, self.most)
        self.signs = signs
        moves = [s * z for s, z in zip(signs, self.sizes, strict=True)]
        return _moved(system, moves[: len(b)], moves[len(b) :])


@register("trainer", "contrastive")
class Contrastive:
    """Contrastive divergence of a two-layer system (visible, hidden); a gauss visible layer also fits variances.

    options: steps, iterations, penalty (pull of hidden means to `expect`), annealing (`temperature`, `power`: falling
    noise on weights and biases), weights_factor, vbias_factor and hbias_factor (of their moves and noise), adaptive (rate from the slope of the weights' variance over `history` updates).
    """

    def __init__(self, schedule: Schedule, rng: np.random.Generator):
        self.o, self.rate, self.rng = schedule.options, schedule.rate, rng
        self.first, self.updates, self.done = schedule.rate, max(1, schedule.updates), 0
        self.variances: list[float] = []

    def _draw(self, u: Units, x: np.ndarray) -> np.ndarray:
        return (x > self.rng.random(x.shape)).astype(float) if u.kind == "sigmoid" else x + self.rng.normal(size=x.shape) * np.exp(u.lvar / 2)

    def _model(self, system: System, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reconstruction after `steps` Gibbs steps, as a mean over `iterations` chains."""
        v, hid = system.layers
        w = system.weights[0]
        chains = int(self.o.get("iterations", 1))
        total_v, total_h = 0.0, 0.0
        for _ in range(chains):
            now = h
            for _ in range(int(self.o.get("steps", 1))):
                seen = _up(hid, v, w.T, self._draw(hid, now))
                now = _up(v, hid, w, seen)
            total_v, total_h = total_v + seen / chains, total_h + now / chains
        return total_v, total_h

    def _adapt(self, w: np.ndarray) -> None:
        length = int(self.o.get("history", 3))
        self.variances = [*self.variances, float(w.var())][-length:]
        if self.o.get("adaptive") and len(self.variances) == length > 1:
            slope = np.polyfit(np.arange(length), self.variances, 1)[0]
            self.rate = float(np.clip(self.o.get("factor", 10.0) * slope, self.o.get("min_rate", self.first / 10), self.o.get("max_rate", self.first)))

    def step(self, system: System, x: np.ndarray, y: np.ndarray) -> System:
        v, h = system.layers
        w = system.weights[0]
        self._adapt(w)
        hx = _up(v, h, w, x)
        vm, hm = self._model(system, hx)
        db, dh, dl = (x - vm).mean(axis=0), (hx - hm).mean(axis=0), np.zeros_like(v.lvar)
        dw = (x.T @ hx - vm.T @ hm) / x.size
        if v.kind == "gauss":
            var = np.exp(v.lvar)
            part = lambda d, e: (0.5 * (d - v.bias) ** 2 - d * (e @ w.T)).mean(axis=0)
            dl = (part(x, hx) - part(vm, hm)) / var * self.o.get("lvar_factor", 0.01)
            db, dw = db / var, dw / var[:, None]
        if t := self.o.get("temperature"):
            heat = t * (1 - self.done / self.updates) ** self.o.get("power", 1.0)
            if heat >= self.o.get("least_temperature", 0.01):
                size = self.first**2 / self.rate * heat / self.rate
                dw, db, dh = (d + size * self.rng.normal(size=d.shape) for d in (dw, db, dh))
        dw, db, dh = (self.o.get(f"{n}_factor", 1.0) * d for n, d in (("weights", dw), ("vbias", db), ("hbias", dh)))
        bias = h.bias + self.rate * dh
        if "penalty" in self.o:
            bias = bias + max(self.rate, self.o["penalty"]) * (self.o.get("expect", 0.5) - hx.mean(axis=0))
        self.done += 1
        layers = (replace(v, bias=v.bias + self.rate * db, lvar=np.clip(v.lvar + self.rate * dl, -8, 8)), replace(h, bias=bias))
        return replace(system, layers=layers, weights=(w + self.rate * dw * system.adjacency[0],))


# ---------------------------------------------------------------- rounds


def flatten(system: System) -> np.ndarray:
    return np.concatenate([*(u.bias for u in system.layers), *(u.lvar for u in system.layers), *(w.ravel() for w in system.weights)])


def unflatten(system: System, flat: np.ndarray) -> System:
    at = 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return flat[at - n : at]

    biases = [take(len(u.labels)) for u in system.layers]
    lvars = [take(len(u.labels)) for u in system.layers]
    weights = tuple(take(w.size).reshape(w.shape) for w in system.weights)
    return replace(system, layers=tuple(replace(u, bias=b, lvar=v) for u, b, v in zip(system.layers, biases, lvars, strict=True)), weights=weights)


def corrupt(x: np.ndarray, noise: tuple[str | None, float], rng: np.random.Generator) -> np.ndarray:
    kind, factor = noise
    if kind is None:
        return x
    if kind == "gauss":
        return x + rng.normal(size=x.shape) * factor
    hit = rng.random(x.shape) < 1 - factor
    if kind == "mask":
        return x * hit
    if kind == "bernoulli":
        return (x != hit).astype(float)
    raise ValueError(f"unknown noise {kind!r}")


def _round(batches: Iterator[pa.RecordBatch], system: System, n_inputs: int, schedule: Schedule, turn: int, steps: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng((schedule.seed, turn, TaskContext.get().partitionId()))
    pool, seen = np.zeros((0, 0)), 0
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        rows = rows[~np.isnan(rows).any(axis=1)]
        if room := max(0, schedule.reservoir - len(pool)):
            head, rows = rows[:room], rows[room:]
            pool = np.vstack([pool, head]) if len(pool) else head
            seen += len(head)
        # beyond the reservoir: each row so far is kept with equal probability
        at = rng.integers(seen + 1 + np.arange(len(rows)))
        kept = np.flatnonzero(at < schedule.reservoir)
        for k in kept:  # of several rows for a place the last stays
            pool[at[k]] = rows[k]
        seen += len(rows)
    if not len(pool):
        return
    trainer = registry.get("trainer", schedule.algorithm)(schedule, rng)
    for k in range(steps):
        if k % schedule.interval == 0:
            part = pool if len(pool) <= schedule.minibatch else pool[rng.integers(len(pool), size=schedule.minibatch)]
        system = trainer.step(system, corrupt(part[:, :n_inputs], schedule.noise, rng), part[:, n_inputs:])
    flat = flatten(system)
    weight = max(seen, len(pool))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * weight), pa.array(np.full(len(flat), float(weight)))], names=["k", "value", "weight"])


def fit(df: DataFrame, system: System, schedule: Schedule = Schedule(), watch: Callable[[int, System], bool | None] | None = None, history: list[tuple[int, float]] | None = None) -> System:
    """The trained system. df has the columns of the first layer and, for gradient trainers, of the last one.

    `watch` sees the parameters after each round and ends the training by returning True; `history` takes the updates
    done and the objective after each round.
    """
    pair = schedule.algorithm == "contrastive"
    inputs = system.layers[0].columns
    names = inputs if pair else [*inputs, *system.layers[-1].columns]
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(names))).cache()
    best, best_value = system, None
    optimum = registry.entry("unit_measure", schedule.objective).meta.get("optimum", "min") if schedule.objective and not pair else None
    rounds = max(1, min(schedule.rounds, schedule.updates))
    try:
        for turn in range(rounds):
            steps = schedule.updates * (turn + 1) // rounds - schedule.updates * turn // rounds
            now, width = system, len(inputs)
            sums = rows.mapInArrow(lambda it, now=now, turn=turn, steps=steps: _round(it, now, width, schedule, turn, steps), "k long, value double, weight double")
            found = sums.groupBy("k").agg((F.sum("value") / F.sum("weight")).alias("v")).collect()  # one row per parameter
            if not found:
                break
            flat = np.zeros(len(found))
            for r in found:
                flat[r["k"]] = r["v"]
            system = unflatten(system, flat)
            stop = watch(turn, system) if watch else False
            if optimum:
                value = measure(df, system, schedule.objective).first()["value"]
                if history is not None:
                    history.append((schedule.updates * (turn + 1) // rounds, value))
                if value is not None and (best_value is None or (value < best_value) == (optimum == "min")):
                    best, best_value = system, value
            if stop:
                break
    finally:
        rows.unpersist()
    return best if optimum and schedule.keep_best and best_value is not None else system


def bprop_step(df: DataFrame, system: System, rate: float = 0.1) -> DataFrame:
    """(parameter, value) of a system without hidden layers after one update over all rows, as one aggregate."""
    return _one_step(df, system, lambda slope: rate * slope)


def rprop_step(df: DataFrame, system: System, start: float = 0.001, grow: float = 1.2) -> DataFrame:
    """As bprop_step, by the first resilient update: a first step has the sign that it is compared with, so it grows."""
    return _one_step(df, system, lambda slope: start * grow * F.signum(slope))


def _one_step(df: DataFrame, system: System, move: Callable[[Column], Column]) -> DataFrame:
    a, b = system.layers
    scaled = forward(df, system, prefix="~")
    error = {t: F.col(f"`~{t}`") - F.col(f"`{t}`") for t in b.columns}
    cells = [F.struct(F.lit(f"bias {t}").alias("parameter"), (float(b.bias[j]) - move(F.avg(error[t]))).alias("value")) for j, t in enumerate(b.columns)]
    cells += [
        F.struct(F.lit(f"weight {s} {t}").alias("parameter"), (float(system.weights[0][i, j]) - move(F.sum(F.col(f"`{s}`") * error[t]) / (F.count("*") * len(a.columns)))).alias("value"))
        for i, s in enumerate(a.columns) for j, t in enumerate(b.columns)
    ]
    return scaled.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def rbm(visible: list[str], hidden: int, kind: str = "gauss") -> System:
    """A two-layer system; visible names have the form `visible:label`."""
    v = Units("visible", tuple(c.partition(":")[2] for c in visible), kind)
    h = Units("hidden", tuple(f"n{k + 1}" for k in range(hidden)), "sigmoid", False)
    a = np.ones((len(visible), hidden))
    return System((v, h), (np.zeros_like(a),), (a,), "rbm")


def pretrain(df: DataFrame, system: System, schedule: Schedule) -> System:
    """A deep system from pairs of layers trained outside in, mirrored at the centre.

    The first pair sees inputs and outputs as one visible layer, each later pair the expectations of the one before.
    """
    centre = (len(system.layers) - 1) // 2
    first, last = system.layers[0], system.layers[-1]
    data = df.select(*(F.col(f"`{c}`").alias(f"visible:{k}") for k, c in enumerate([*first.columns, *last.columns])))
    layers, weights = list(system.layers), list(system.weights)
    n_in = len(first.labels)
    for k in range(centre):
        kind = first.kind if k == 0 else "sigmoid"
        pair = rbm(data.columns, len(system.layers[k + 1].labels), kind)
        pair = initialize(pair, data if kind == "gauss" else None, seed=schedule.seed + k)
        pair = fit(data, pair, replace(schedule, algorithm="contrastive", objective=None, seed=schedule.seed + 100 * k))
        v, h = pair.layers
        w = pair.weights[0]
        if k == 0:
            layers[0] = replace(first, bias=v.bias[:n_in], lvar=v.lvar[:n_in])
            layers[-1] = replace(last, bias=v.bias[n_in:], lvar=v.lvar[n_in:])
            weights[0], weights[-1] = w[:n_in], w[n_in:].T
        else:
            weights[k], weights[-1 - k] = w, w.T
        layers[k + 1] = replace(layers[k + 1], bias=h.bias)
        layers[-2 - k] = replace(layers[-2 - k], bias=h.bias)
        hidden = forward(data, pair)
        data = hidden.select(*(F.col(f"`{c}`").alias(f"visible:{j}") for j, c in enumerate(h.columns)))
    return replace(system, layers=tuple(layers), weights=tuple(w * a for w, a in zip(weights, system.adjacency, strict=True)))


def fit_deep(df: DataFrame, system: System, schedule: Schedule) -> System:
    """Pretraining, then fine-tuning by gradients."""
    return fit(df, pretrain(df, system, schedule), replace(schedule, algorithm="bprop"))
