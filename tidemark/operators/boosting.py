"""Gradient-boosted trees that learn a side for missing values, trained over all rows of a table.

Values become bins once, a byte each, stored beside the label. A level of a tree is one pass: each
task walks its rows down the trees so far, adds up gradients by node, feature and bin, and sends
those sums; Spark adds them up over tasks, and the driver, which sees sums only, picks the splits.
Missing values have a bin of their own and go where the gain is larger. Several models (folds, say)
are trained in the same passes.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.backtest import folds
from tidemark.sources import scratch

#: Rounds after which the margins so far are stored, so that a pass walks no more trees than these.
STORED_EVERY = 50


@dataclass(frozen=True)
class Params:
    """loss is logistic or squared. A positive row weighs `positive_weight`. With patience, training ends after so many
    rounds without a gain on validation rows, and the trees up to the best one stay."""

    rounds: int = 500
    depth: int = 3
    rate: float = 0.05
    rows_share: float = 0.8
    columns_share: float = 0.7
    least_weight: float = 30.0
    gamma: float = 2.0
    alpha: float = 0.5
    lam: float = 2.0
    patience: int | None = 50
    loss: str = "logistic"
    positive_weight: float = 1.0
    bins: int = 64
    seed: int = 42


#: The settings of the classifier and of the regressor.
CLASSIFIER = Params()
REGRESSOR = Params(rounds=300, depth=4, rate=0.03, least_weight=10.0, gamma=0.0, alpha=0.3, lam=1.5, patience=None, loss="squared")


@dataclass
class Tree:
    """Nodes in arrays; a leaf is its own child. A row goes left if its bin is at most `bin`, or as `missing_left` says."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: tuple[float, float]) -> None:
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = feature, cut, missing_left, gain
        for side, value in zip((self.left, self.right), values):
            side[node] = len(self.value)
            for x, v in ((self.feature, 0), (self.bin, 0), (self.missing_left, True), (self.value, value), (self.gain, 0.0)):
                x.append(v)
            self.left.append(len(self.left))
            self.right.append(len(self.right))

    def nodes(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """The node that each row of bins comes to."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        side = np.array(self.missing_left)
        for _ in range(len(self.value)):
            own = bins[np.arange(len(bins)), feature[at]]
            to = np.where(np.where(own == missing, side[at], own <= cut[at]), left[at], right[at])
            if (to == at).all():
                return at
            at = to
        return at


@dataclass
class Boosted:
    """A fitted model: its columns, the cuts of their bins, trees, and the margin that all rows start with."""

    columns: list[str]
    cuts: dict[str, list[float]]
    params: Params
    trees: list[Tree]
    base: float

    def importances(self) -> list[tuple[str, float]]:
        """Each column's share of all gain, the largest first."""
        total = dict.fromkeys(self.columns, 0.0)
        for t in self.trees:
            for n, g in enumerate(t.gain):
                if t.left[n] != n:
                    total[self.columns[t.feature[n]]] += g
        whole = sum(total.values()) or 1.0
        return sorted(((c, g / whole) for c, g in total.items()), key=lambda x: (-x[1], x[0]))

    def sql(self) -> str:
        """The prediction as SQL text over the columns: a probability, or the value of a regression."""

        def node(t: Tree, n: int) -> str:
            if t.left[n] == n:
                return repr(t.value[n])
            c = self.columns[t.feature[n]]
            cut = f'"{c}" <= CAST({self.cuts[c][t.bin[n]]!r} AS DOUBLE)' if t.bin[n] < len(self.cuts[c]) else f'"{c}" IS NOT NULL'
            test = f'coalesce({cut}, {str(t.missing_left[n]).lower()})'
            return f"CASE WHEN {test} THEN {node(t, t.left[n])} ELSE {node(t, t.right[n])} END"

        margin = " + ".join([f"CAST({self.base!r} AS DOUBLE)", *(f"CAST({node(t, 0)} AS DOUBLE)" for t in self.trees)])
        return f"1 / (1 + exp(-({margin})))" if self.params.loss == "logistic" else margin

    def predict(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """`df` with the prediction; nulls and NaN are missing values."""
        columns, cuts, trees, base, logistic, n_bins = self.columns, self.cuts, self.trees, self.base, self.params.loss == "logistic", self.params.bins
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _binned(batch.columns[len(names) :], columns, cuts, n_bins)
                margin = base + sum((np.array(t.value)[t.nodes(bins, n_bins)] for t in trees), np.zeros(batch.num_rows))
                made = pa.array(1 / (1 + np.exp(-margin)) if logistic else margin)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], made], names=[*names, out])

        inputs = df.select(*names, *(F.col(c).cast("double").alias(f"in_{k}") for k, c in enumerate(columns)))
        return inputs.mapInArrow(run, _with(df, out))


def _with(df: DataFrame, out: str):
    return df.select(*df.columns, F.lit(0.0).alias(out)).schema


def _binned(columns: list[pa.Array], names: list[str], cuts: dict[str, list[float]], missing: int) -> np.ndarray:
    """Bin of each value, how many cuts lie below it; `missing` for null and NaN."""
    out = np.empty((len(columns[0]) if columns else 0, len(names)), np.uint8)
    for k, (c, x) in enumerate(zip(names, columns)):
        x = x.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, k] = np.where(np.isnan(x), missing, np.searchsorted(np.array(cuts[c]), x, "left"))
    return out


def quantile_cuts(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """At most bins - 1 cuts a column, near its quantiles, from one pass of sketches."""
    at = [k / bins for k in range(1, bins)]
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    one = df.agg(*(F.percentile_approx(v, at, 100 * bins).alias(c) for c, v in x.items())).first()
    return {c: sorted(set(one[c] or [])) for c in columns}


def _prepared(df: DataFrame, columns: list[str], cuts: dict[str, list[float]], label: str, roles: list[Column], key: Column, bins: int, base: list[float]) -> DataFrame:
    """Stored rows: bins (a byte a column), label, key (a number that sampling goes by), roles and margins (one a model)."""
    n, k = len(columns), len(roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _binned(batch.columns[:n], columns, cuts, bins)
            role = np.stack([c.to_numpy(zero_copy_only=False).astype(np.uint8) for c in batch.columns[n + 2 :]], axis=1)
            margins = np.tile(np.array(base), (batch.num_rows, 1))
            arrays = [_bytes(made), batch.column(n), batch.column(n + 1), _bytes(role), _bytes(margins)]
            yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    chosen = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.col(label).cast("double").alias("y"), key.alias("key"), *(F.coalesce(r.cast("int"), F.lit(0)).alias(f"r{i}") for i, r in enumerate(roles)))
    used = F.greatest(*(F.col(f"r{i}") for i in range(k)), F.lit(0)) > 0
    return scratch.stored(chosen.filter(used & F.col("y").isNotNull()).mapInArrow(run, _ROW), "boosting")


_ROW = "bins binary, y double, key long, roles binary, margins binary"
_NAMES = ["bins", "y", "key", "roles", "margins"]


def _bytes(x: np.ndarray) -> pa.Array:
    """A row of a matrix a value."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _sampled(key: np.ndarray, number: int, share: float) -> np.ndarray:
    """A share of the rows by a hash of their key and the round's number."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64(number % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < share * 2**53


def _number(seed: int, model: int, number: int) -> int:
    return random.Random(f"{seed}:{model}:{number}").getrandbits(63)


TRAIN, VALIDATION = 1, 2


@dataclass
class _State:
    """A model in training: its trees, those not yet in the stored margins, and the tree in the making with its open nodes."""

    params: Params
    trees: list[Tree]
    fresh: list[Tree]
    tree: Tree
    open: list[int]
    best: float = float("inf")
    best_round: int = 0
    done: bool = False


def _sums(states: list[_State], width: int, number: int):
    """For mapInArrow: per model, validation loss and weight, then gradients and weights by open node, column and bin."""
    plain = [(s.params, s.fresh, s.tree, s.open, s.done, _number(s.params.seed, k, number)) for k, s in enumerate(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 + 2 * len(nodes) * width * (p.bins + 1)) for p, _, _, nodes, _, _ in plain]
        for batch in batches:
            bins, y = _matrix(batch.column(0), np.uint8, width), batch.column(1).to_numpy()
            key, roles = batch.column(2).to_numpy(), _matrix(batch.column(3), np.uint8, len(plain))
            margins = _matrix(batch.column(4), np.float64, len(plain))
            for k, (p, fresh, tree, nodes, done, draw) in enumerate(plain):
                rows = np.flatnonzero(roles[:, k])
                if done or not len(rows):
                    continue
                own, x = bins[rows], y[rows]
                margin = margins[rows, k] + sum((np.array(t.value)[t.nodes(own, p.bins)] for t in fresh), np.zeros(len(rows)))
                if p.loss == "logistic":
                    proba = 1 / (1 + np.exp(-margin))
                    weight = np.where(x > 0, p.positive_weight, 1.0)
                    g, h = weight * (proba - x), weight * proba * (1 - proba)
                    loss = -weight * np.where(x > 0, np.log(np.maximum(proba, 1e-15)), np.log(np.maximum(1 - proba, 1e-15)))
                else:
                    weight, g, h = np.ones(len(x)), margin - x, np.ones(len(x))
                    loss = (margin - x) ** 2
                held = roles[rows, k] == VALIDATION
                totals[k][0] += loss[held].sum()
                totals[k][1] += weight[held].sum()
                used = (roles[rows, k] == TRAIN) & _sampled(key[rows], draw, p.rows_share)
                at = tree.nodes(own[used], p.bins)
                place = np.full(len(tree.value), -1)
                place[nodes] = np.arange(len(nodes))
                inside = place[at] >= 0
                base = (place[at][inside][:, None] * width + np.arange(width)) * (p.bins + 1) + own[used][inside]
                size = len(nodes) * width * (p.bins + 1)
                for part, v in ((0, g), (1, h)):
                    weights = np.repeat(v[used][inside], width)
                    totals[k][2 + part * size : 2 + (part + 1) * size] += np.bincount(base.ravel(), weights, size)
        for k, t in enumerate(totals):
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(t[some])], names=["model", "i", "s"])

    return run


def _gain(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    t = np.sign(g) * np.maximum(np.abs(g) - p.alpha, 0.0)
    return t * t / (h + p.lam)


def _leaf(g: float, h: float, p: Params) -> float:
    t = max(abs(g) - p.alpha, 0.0) * (1 if g > 0 else -1)
    return float(-p.rate * t / (h + p.lam))


def best_split(g: np.ndarray, h: np.ndarray, p: Params, columns: list[int]) -> tuple | None:
    """(gain, column, bin, missing_left, left sums, right sums) of a node out of its sums by column and bin (missing last).

    Gains are compared at nine digits, ties go to the first column, the lower cut, and missing values to the left.
    """
    found = None
    for c in columns:
        total_g, total_h = g[c].sum(), h[c].sum()
        left_g, left_h = np.cumsum(g[c, :-1])[:-1], np.cumsum(h[c, :-1])[:-1]
        for missing_left in (True, False):
            lg, lh = (left_g + g[c, -1], left_h + h[c, -1]) if missing_left else (left_g, left_h)
            rg, rh = total_g - lg, total_h - lh
            gain = 0.5 * (_gain(lg, lh, p) + _gain(rg, rh, p) - _gain(total_g, total_h, p)) - p.gamma
            gain = np.where((lh >= p.least_weight) & (rh >= p.least_weight) & (lh > 0) & (rh > 0), gain, -np.inf)
            if not len(gain):
                continue
            shown = np.array([float(f"{x:.9g}") for x in gain])
            k = int(shown.argmax())
            if shown[k] > 0 and (found is None or shown[k] > found[0]):
                found = (float(shown[k]), c, k, missing_left, (lg[k], lh[k]), (rg[k], rh[k]))
    return found


def fit_many(
    df: DataFrame, columns: list[str], label: str, roles: list[Column], params: list[Params], key: Column, cuts: dict[str, list[float]] | None = None,
    watch: Callable[[int], None] | None = None,
) -> list[Boosted]:
    """A model for each of `roles`: columns that are 1 on its training rows, 2 on its validation rows, else 0 or null.

    Rows without a label take no part. `key` is a number of the row, by a hash of which rows are drawn
    in each round. Passes over the data: one a level and round, whatever the number of models.
    """
    bins = max(p.bins for p in params)
    params = [replace(p, bins=bins) for p in params]
    cuts = cuts or quantile_cuts(df, columns, bins)
    if any(len(c) >= bins for c in cuts.values()) or bins > 255:
        raise ValueError("a column has more cuts than bins, or there are more than 255 bins")
    y = F.col(label).cast("double")
    starts = df.agg(*(F.avg(F.when(r == TRAIN, F.when(y > 0, p.positive_weight).otherwise(0.0) if p.loss == "logistic" else y)).alias(f"s{k}") for k, (r, p) in enumerate(zip(roles, params))),
                    *(F.avg(F.when((r == TRAIN) & y.isNotNull(), F.when(y > 0, p.positive_weight).otherwise(1.0))).alias(f"w{k}") for k, (r, p) in enumerate(zip(roles, params)))).first()
    base = []
    for k, p in enumerate(params):
        share = (starts[f"s{k}"] or 0.0) / (starts[f"w{k}"] or 1.0) if p.loss == "logistic" else starts[f"s{k}"] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6) if p.loss == "logistic" else share
        base.append(log(share / (1 - share)) if p.loss == "logistic" else share)
    rows = _prepared(df, columns, cuts, label, roles, key, bins, base)
    states = [_State(p, [], [], Tree(), [0]) for p in params]
    number = 0
    while not all(s.done for s in states):
        for k, s in enumerate(states):
            s.tree, s.open = Tree(), [0]
        drawn = [sorted(random.Random(f"{p.seed}:{k}:{number}:columns").sample(range(len(columns)), max(1, round(p.columns_share * len(columns))))) for k, p in enumerate(params)]
        for level in range(max(p.depth for p in params)):
            found = rows.mapInArrow(_sums(states, len(columns), number), "model int, i int, s double").groupBy("model", "i").agg(F.sum("s").alias("s")).toArrow()
            grown = False
            for k, s in enumerate(states):
                if s.done:
                    continue
                size = len(s.open) * len(columns) * (bins + 1)
                total = np.zeros(2 + 2 * size)
                own = found.column("model").to_numpy() == k
                total[found.column("i").to_numpy()[own]] = found.column("s").to_numpy()[own]
                if level == 0:
                    _judge(s, total, number)
                if s.done or level >= s.params.depth:
                    continue
                sums = total[2:].reshape(2, len(s.open), len(columns), bins + 1)
                following = []
                for j, node in enumerate(s.open):
                    best = best_split(sums[0, j], sums[1, j], s.params, drawn[k])
                    if best is None:
                        if level == 0:
                            s.tree.value[0] = 0.0
                        continue
                    gain, c, cut, missing_left, left, right = best
                    s.tree.split(node, c, cut, missing_left, gain, (_leaf(*left, s.params), _leaf(*right, s.params)))
                    following += [s.tree.left[node], s.tree.right[node]]
                s.open = following
                grown |= bool(following)
            if not grown:
                break
        for s in states:
            if not s.done:
                s.trees.append(s.tree)
                s.fresh.append(s.tree)
                if s.params.patience is None and len(s.trees) >= s.params.rounds:
                    s.done = True
        number += 1
        if watch:
            watch(number)
        if number % STORED_EVERY == 0 and not all(s.done for s in states):
            rows = _walked(rows, states, len(columns))
            for s in states:
                s.fresh = []
    out = []
    for k, s in enumerate(states):
        trees = s.trees if s.params.patience is None else s.trees[: s.best_round]
        out.append(Boosted(list(columns), cuts, params[k], trees, base[k]))
    return out


def _judge(s: _State, total: np.ndarray, number: int) -> None:
    """Takes the loss of the trees so far; ends a model that gains no more, has all its rounds, or no validation rows to go by."""
    if s.params.patience is None:
        return
    if total[1] > 0:
        loss = total[0] / total[1]
        if loss < s.best - 1e-12:
            s.best, s.best_round = loss, number
    else:
        s.best_round = number
    s.done = number >= s.params.rounds or number - s.best_round >= s.params.patience


def _walked(rows: DataFrame, states: list[_State], width: int) -> DataFrame:
    plain = [(s.params.bins, s.fresh) for s in states]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margins = _matrix(batch.column(0), np.uint8, width), _matrix(batch.column(4), np.float64, len(plain)).copy()
            for k, (missing, trees) in enumerate(plain):
                for t in trees:
                    margins[:, k] += np.array(t.value)[t.nodes(bins, missing)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _bytes(margins)], names=_NAMES)

    return scratch.stored(rows.mapInArrow(run, _ROW), "boosting")


def fit(df: DataFrame, columns: list[str], label: str, role: Column, params: Params, key: Column, cuts: dict[str, list[float]] | None = None) -> Boosted:
    return fit_many(df, columns, label, [role], [params], key, cuts)[0]


def fit_two_stage(split: DataFrame, columns: list[str], params: Params, key: Column) -> tuple[Boosted, Boosted]:
    """A model of label from the training rows, and one that tells from validation rows when the first is right.

    The second sees the first's probability besides the features, and rows the first hasn't learned from.
    """
    first = fit(split, columns, "label", F.when(F.col("split") == "train", TRAIN), params, key)
    seen = first.predict(split.filter("split = 'validation'"), "model1_prob_up")
    right = ((F.col("model1_prob_up") >= 0.5).cast("int") == F.col("label")).cast("int")
    return first, fit(seen.withColumn("right_", right), [*columns, "model1_prob_up"], "right_", F.lit(TRAIN), params, key)


def two_stage(first: Boosted, second: Boosted, df: DataFrame) -> DataFrame:
    """The first model's side (pred) and probability, and the probability of the second, which sees the first's."""
    d = first.predict(df, "model1_prob_up")
    return second.predict(d.withColumn("pred", (F.col("model1_prob_up") >= 0.5).cast("int")), "proba")


RESULT = "fold int, n_train long, n_test long, accuracy double, majority double, edge double"


def walk_forward(df: DataFrame, columns: list[str], label: str, params: Params, key: Column, k: int = 5, time: str = "open_time", min_block: int = 100) -> DataFrame:
    """Accuracy of a model on each of `k` expanding folds in time, the majority's, and the edge over it.

    The folds' models are trained in the same passes. Folds go by times, cut where they divide the
    rows evenly (within the quantile's error), so that rows of one time stay together; folds with a
    single class in training or test rows are left out.
    """
    data = df.filter(F.col(label).isNotNull())
    n = data.count()
    spans = []
    for train_end, _, test_end in folds(n, k, min_block):
        spans.append(data.approxQuantile(time, [train_end / n, min(1.0, test_end / n)], 0.0005))
    if not spans:
        return df.sparkSession.createDataFrame([], RESULT)
    models = fit_many(data, columns, label, [F.when(F.col(time) <= lo, TRAIN) for lo, _ in spans], [params] * len(spans), key)
    rows = []
    for i, ((lo, hi), model) in enumerate(zip(spans, models)):
        train = data.filter(F.col(time) <= lo).agg(F.count("*").alias("n"), F.avg(label).alias("up")).first()
        p = model.predict(data.filter((F.col(time) > lo) & (F.col(time) <= hi)))
        a = p.agg(F.count("*").alias("n"), F.avg(((F.col("proba") >= 0.5).cast("int") == F.col(label)).cast("double")).alias("acc"), F.avg(label).alias("up")).first()
        if not a["n"] or a["up"] in (0.0, 1.0) or train["up"] in (0.0, 1.0):
            continue
        major = max(a["up"], 1 - a["up"])
        rows.append((i, train["n"], a["n"], a["acc"], major, a["acc"] - major))
    return df.sparkSession.createDataFrame(rows, RESULT)
