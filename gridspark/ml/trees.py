"""Second-order boosted trees and forests on histograms, many fits in one pass.

Features are cut into bins once.  A tree grows level by level: one aggregate sums the gradients
and curvatures of the loss by (tree, node, feature, bin), and the best split of every node follows
from those sums alone.  All fits that are asked for together (folds, parameter sets, the trees of
a forest) share the binned rows and the aggregates, so a search takes as many jobs as its longest
fit.  Predictions so far are kept as a column, rewritten to the shared folder every few rounds;
trees that are newer are applied on the way.

Gradients are summed as whole numbers, so trees depend on the rows and bins, not on how the rows
are dealt out.  The driver sees sums and trees only: their size is set by the parameters.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import as_list
from ..session import materialize

BINS = 64
KEEP = 10  # rounds after which predictions are written anew
CELLS = 1 << 21  # sums in one aggregate; more trees are grown one group after another
FINE = 1 << 30  # units in which gradients are summed
TRAIN, HELD, OUT = 0, 1, 2
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Fit:
    """Parameters of one ensemble, and SQL conditions for its training and held-out rows."""

    train: str = "true"
    held: str = "false"
    loss: str = "squared"  # or "logistic"
    rounds: int = 40
    patience: int | None = None  # rounds without gain on the held-out rows after which to stop
    follow: tuple[int, ...] = ()  # numbers of the fits with the last of which this one ends
    depth: int = 5
    leaves: int | None = None  # of a level only the best splits are made, so that there are no more leaves
    eta: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0  # gain that a split has to exceed
    min_child: float = 1.0  # least curvature of a child
    rows: float = 1.0  # share of rows for a tree
    columns: float = 1.0  # share of features for a tree
    forest: bool = False  # `rounds` independent trees on bootstrapped rows, averaged
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    depth: int

    @classmethod
    def of(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), depth)

    def leaf(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Node of every row after `depth` steps."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth if depth is None else depth):
            f = self.feature[at]
            step = 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.bin[at])
            at = np.where(f >= 0, step, at)
        return at

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(bins)]


def spread(ident: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the row and the seed alone."""
    x = ident.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        p = sigmoid(margin)
        return p - y, p * (1 - p)
    return margin - y, np.ones_like(y)


def losses(loss: str, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    if loss == "logistic":
        p = np.clip(sigmoid(margin), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p))
    return (y - margin) ** 2


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


@dataclass
class Ensemble:
    """A fitted model; `transform` adds `prediction` (of a classifier also `likelihood`)."""

    features: list[str]
    splits: list[list[float]]
    trees: list[Tree]
    base: float
    loss: str = "squared"
    errors: list[float] = field(default_factory=list)  # held-out error after 0, 1, … trees

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(s, values[:, k]) for k, s in enumerate(self.splits)]) if len(values) else np.zeros((0, len(self.splits)), int)

    def margin(self, values: np.ndarray) -> np.ndarray:
        bins = self.binned(values)
        return sum((t(bins) for t in self.trees), np.full(len(bins), self.base))

    def transform(self, df: DataFrame) -> DataFrame:
        model = replace(self, errors=[])

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.margin(np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])))

        out = df.withColumn("prediction", score(*(F.col(f"`{c}`").cast("double") for c in self.features)))
        if self.loss != "logistic":
            return out
        return out.withColumn("likelihood", 1 / (1 + F.exp(-F.col("prediction")))).withColumn("prediction", (F.col("likelihood") > 0.5).cast("double"))

    def importances(self) -> np.ndarray:
        """Shares of the features in the gain of all splits."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return total / total.sum() if total.sum() else total

    def first(self, trees: int) -> Ensemble:
        """The ensemble as it was after so many rounds."""
        return replace(self, trees=self.trees[:trees], errors=self.errors[: trees + 1])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: tree, node, feature (null at leaves), threshold, value, gain."""
        rows = [
            (t, n, self.features[f], self.splits[f][tree.bin[n]], 0.0, float(tree.gain[n])) if (f := int(tree.feature[n])) >= 0
            else (t, n, None, None, float(tree.value[n]), 0.0)
            for t, tree in enumerate(self.trees)
            for n in _present(tree)
        ]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, value double, gain double")

    def described(self) -> str:
        """The model as text, for a manifest."""
        trees = [{"depth": t.depth, **{k: getattr(t, k).tolist() for k in ("feature", "bin", "value", "gain")}} for t in self.trees]
        return json.dumps({"features": self.features, "splits": self.splits, "base": self.base, "loss": self.loss, "trees": trees})

    @classmethod
    def read(cls, text: str) -> Ensemble:
        d = json.loads(text)
        trees = [Tree(*(np.array(t[k]) for k in ("feature", "bin", "value", "gain")), t["depth"]) for t in d["trees"]]
        return cls(d["features"], d["splits"], trees, d["base"], d["loss"])


def _present(tree: Tree) -> Iterator[int]:
    todo = [0]
    while todo:
        n = todo.pop()
        yield n
        if tree.feature[n] >= 0:
            todo += [2 * n + 2, 2 * n + 1]


def bin_splits(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Up to `bins` - 1 increasing split values of every feature; one pass."""
    probs = [k / bins for k in range(1, bins)]
    typed = df.select(*(F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)))
    found = typed.approxQuantile(typed.columns, probs, 0.25 / bins)
    return [sorted(set(v)) for v in found]


def bin_rows(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str] | str, fits: Sequence[Fit], splits: list[list[float]]) -> DataFrame:
    """id, y, bins and the role of every row in every fit.  A bin is the number of splits below the
    value; missing values count as the largest."""
    edges = [np.array(s) for s in splits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f"f{k}").to_numpy(zero_copy_only=False) for k in range(len(edges))]
            bins = np.column_stack([np.searchsorted(e, np.nan_to_num(c, nan=np.inf)) for e, c in zip(edges, columns)]).astype(np.int16)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bins.ravel()), len(edges)).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), lists, batch.column("roles")], names=["id", "y", "bins", "roles"])

    role = [F.when(F.expr(f.held), HELD).when(F.expr(f.train), TRAIN).otherwise(OUT).cast("tinyint") for f in fits]
    rows = df.where(F.col(f"`{target}`").isNotNull()).select(
        F.xxhash64(*(F.col(f"`{c}`") for c in as_list(key))).alias("id"),
        F.col(f"`{target}`").cast("double").alias("y"),
        F.array(*role).alias("roles"),
        *(F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)),
    )
    return rows.mapInArrow(run, "id long, y double, bins array<short>, roles array<tinyint>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Growth:
    """The state of all fits: their trees, and the table with the predictions so far."""

    def __init__(self, rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], width: int):
        self.rows, self.fits, self.features, self.width = rows, list(fits), list(features), width
        roles = [F.get("roles", F.lit(k)) for k in range(len(fits))]
        train = [F.when(r == TRAIN, F.col("y")) for r in roles]
        held = [F.count_if(r == HELD) for r in roles]
        found = rows.agg(
            F.array(*map(F.avg, train)).alias("mean"),
            F.array(*held).alias("held"),
            F.max(F.abs("y")).alias("top"),
        ).first()
        self.held, self.tasks = found["held"], rows.rdd.getNumPartitions()
        top = max(1.0, 2 * (found["top"] or 0.0))
        self.base = [self._base(f, m) for f, m in zip(fits, found["mean"])]
        self.unit = [FINE if f.loss == "logistic" else FINE / top for f in fits]
        self.loss_unit = [FINE / 64 if f.loss == "logistic" else FINE / top**2 for f in fits]
        self.trees: list[list[Tree]] = [[] for _ in fits]
        self.kept = 0  # trees that the written predictions hold
        self.errors: list[list[float]] = [[] for _ in fits]

    @staticmethod
    def _base(fit: Fit, mean: float | None) -> float:
        if mean is None:
            return 0.0
        if fit.loss == "logistic":
            p = min(max(mean, 1e-6), 1 - 1e-6)
            return math.log(p / (1 - p))
        return mean

    def newer(self) -> list[list[Tree]]:
        """The trees that the written predictions lack; those of forests are never written."""
        return [t if f.forest else t[self.kept :] for f, t in zip(self.fits, self.trees)]

    def keep(self) -> None:
        """Write the predictions with all trees so far."""
        base, kept, trees = self.base, self.kept, self.newer()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = _margins(batch, base, kept, trees, len(base))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(margins.ravel()), len(base)).cast(pa.list_(pa.float64()))
                columns = [batch.column(c) for c in ("id", "y", "bins", "roles")]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["id", "y", "bins", "roles", "margins"])

        schema = "id long, y double, bins array<short>, roles array<tinyint>, margins array<double>"
        self.rows = materialize(self.rows.mapInArrow(run, schema), "margins")
        self.kept = max(map(len, self.trees))

    def sums(self, growing: list[tuple[int, int, Tree]], level: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each of the `growing` (fit, seed, tree) the gradients and curvatures by node of the
        level, feature and bin; at level 0 also the held-out errors of the fits."""
        fits, base, kept, new = self.fits, self.base, self.kept, self.newer()
        unit, loss_unit, width = self.unit, self.loss_unit, self.width
        nodes, depth_start = 2**level, 2**level - 1
        cells = nodes * width * (BINS + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, len(growing) * cells), np.int64)
            error = np.zeros(len(fits), np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                bins, roles = _matrix(batch.column("bins"), width), _matrix(batch.column("roles"), len(fits))
                margins = _margins(batch, base, kept, new, len(fits))
                y, ident = batch.column("y").to_numpy(), batch.column("id").to_numpy()
                if level == 0:
                    for k, fit in enumerate(fits):
                        at = roles[:, k] == HELD
                        error[k] += int(np.rint(losses(fit.loss, y[at], margins[at, k]) * loss_unit[k]).astype(np.int64).sum())
                for n, (k, seed, tree) in enumerate(growing):
                    fit = fits[k]
                    use = roles[:, k] == TRAIN
                    if fit.rows < 1:
                        use &= spread(ident, seed) < fit.rows
                    at = np.flatnonzero(use)
                    place = tree.leaf(bins[at], level) - depth_start
                    at, place = at[place >= 0], place[place >= 0]  # rows in leaves above have no place
                    start = np.full(len(at), base[k]) if fit.forest else margins[at, k]
                    g, h = gradients(fit.loss, y[at], start)
                    if fit.forest:
                        times = np.searchsorted(POISSON, spread(ident[at], seed + 1))
                        g, h = g * times, h * times
                    g, h = np.rint(g * unit[k]), np.rint(h * FINE)
                    cell = (place[:, None] * width + np.arange(width)) * (BINS + 1) + bins[at]
                    part = slice(n * cells, (n + 1) * cells)
                    for row, v in ((0, g), (1, h)):  # sums of a batch are whole numbers that floats hold
                        total[row, part] += np.bincount(cell.ravel(), np.repeat(v, width), cells).astype(np.int64)
            some = np.flatnonzero(total[1])
            cell = np.concatenate([some, -1 - np.arange(len(fits))]) if level == 0 else some
            g, h = (np.concatenate([total[row, some], e]) if level == 0 else total[row, some] for row, e in ((0, error), (1, np.zeros_like(error))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cell, g, h)], names=["cell", "g", "h"])

        # Tasks send one row per cell; as many reducers as keep their input to some millions of rows.
        parts = self.rows.mapInArrow(run, "cell long, g long, h long").repartition(1 + len(growing) * cells * self.tasks // (1 << 22), "cell")
        found = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        cell, g, h = (found.column(c).to_numpy() for c in ("cell", "g", "h"))
        if level == 0:
            self.latest = {int(-1 - c): int(v) for c, v in zip(cell[cell < 0], g[cell < 0])}
        inside = cell >= 0
        sums = np.zeros((2, len(growing) * cells))
        sums[0, cell[inside]], sums[1, cell[inside]] = g[inside], h[inside]
        shape = (nodes, width, BINS + 1)
        return {
            n: (sums[0, n * cells : (n + 1) * cells].reshape(shape) / unit[k], sums[1, n * cells : (n + 1) * cells].reshape(shape) / FINE)
            for n, (k, _, _) in enumerate(growing)
        }

    def split(self, fit: Fit, tree: Tree, seed: int, level: int, g: np.ndarray, h: np.ndarray) -> bool:
        """Best splits of the nodes of a level; whether there was any."""
        nodes, width, _ = g.shape
        start = 2**level - 1
        rng = np.random.default_rng(seed)
        use = np.ones(width, bool)
        if fit.columns < 1:
            use = np.isin(np.arange(width), rng.permutation(width)[: max(1, round(fit.columns * width))])
        whole_g, whole_h = g[:, 0].sum(-1), h[:, 0].sum(-1)  # every row is in one bin of each feature
        if level == 0:
            tree.value[0] = self._weight(fit, whole_g[0], whole_h[0])
        left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
        right_g, right_h = whole_g[:, None, None] - left_g, whole_h[:, None, None] - left_h

        def score(a, b):
            return np.divide(shrunk(a, fit.l1) ** 2, b + fit.l2, out=np.zeros_like(a), where=b + fit.l2 > 0)

        gain = (score(left_g, left_h) + score(right_g, right_h) - score(whole_g, whole_h)[:, None, None]) / 2 - fit.gamma
        least = max(fit.min_child, 1e-9)
        gain = np.where((left_h >= least) & (right_h >= least) & use[None, :, None], gain, -np.inf)
        flat = gain.reshape(nodes, -1)
        best = np.round(flat, 9).argmax(1)  # ties: first feature, then first bin
        value = flat[np.arange(nodes), best]
        order = [n for n in np.argsort(-value, kind="stable") if value[n] > 1e-9]
        if fit.leaves:
            now = int((tree.feature >= 0).sum()) + 1
            order = order[: max(0, fit.leaves - now)]
        for n in order:
            f, b = divmod(int(best[n]), gain.shape[-1])
            at = start + n
            tree.feature[at], tree.bin[at], tree.gain[at] = f, b, value[n]
            for child, (a, c) in ((2 * at + 1, (left_g, left_h)), (2 * at + 2, (right_g, right_h))):
                tree.value[child] = self._weight(fit, a[n, f, b], c[n, f, b])
        return bool(len(order))

    @staticmethod
    def _weight(fit: Fit, g: float, h: float) -> float:
        step = 1.0 / fit.rounds if fit.forest else fit.eta
        return float(-step * shrunk(np.float64(g), fit.l1) / (h + fit.l2)) if h + fit.l2 > 0 else 0.0

    def grow(self, growing: list[tuple[int, int, Tree]]) -> None:
        """All levels of the given trees."""
        depth = max(self.fits[k].depth for k, _, _ in growing)
        alive = growing
        for level in range(depth):
            alive = [x for x in alive if self.fits[x[0]].depth > level]
            if not alive:
                return
            sums, still = self.sums(alive, level), []
            for n, (k, seed, tree) in enumerate(alive):
                if self.split(self.fits[k], tree, seed, level, *sums[n]):
                    still.append((k, seed, tree))
            alive = still

    def record(self) -> None:
        """Held-out errors, as the last aggregate of a level 0 found them."""
        for k, n in enumerate(self.held):
            if n:
                self.errors[k].append(self.latest.get(k, 0) / self.loss_unit[k] / n)


def _margins(batch: pa.RecordBatch, base: list[float], kept: int, new: list[list[Tree]], fits: int) -> np.ndarray:
    """Predictions of all fits for the rows of a batch."""
    out = _matrix(batch.column("margins"), fits).copy() if kept else np.tile(np.array(base, dtype=float), (len(batch), 1))
    if any(new) and len(batch):
        flat = batch.column("bins").flatten().to_numpy(zero_copy_only=False)
        bins = flat.reshape(len(batch), -1)
        for k, trees in enumerate(new):
            for t in trees:
                out[:, k] += t(bins)
    return out


def fit_trees(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str] | str, fits: Sequence[Fit], splits: list[list[float]] | None = None) -> list[Ensemble]:
    """An ensemble for each of the fits, grown together.

    A fit ends after its rounds, or as soon as its held-out error has not improved for
    `patience` rounds; it keeps all trees that it has grown then, and the errors after each (use
    `best_round` and `Ensemble.first`).  `splits` fixes the split values, by default quantiles of
    all rows.  Rows without a target take no part; missing features count as the largest values.
    Rows that share the key are sampled alike.
    """
    features = list(features)
    splits = bin_splits(df, features) if splits is None else splits
    rows = materialize(bin_rows(df, features, target, key, fits, splits), "binned")
    state = _Growth(rows, features, fits, len(features))
    live = {k for k, f in enumerate(fits) if not f.forest}
    forests = [(k, f.seed + 1000 * (n + 1)) for k, f in enumerate(fits) if f.forest for n in range(f.rounds)]
    at = 0
    while live:
        growing = [(k, fits[k].seed + 1000 * (at + 1), Tree.of(fits[k].depth)) for k in sorted(live)]
        for group in _groups(growing, state):
            state.grow(group)
            if group[0] is growing[0]:
                state.record()
        for k, _, tree in growing:
            state.trees[k].append(tree)
        at += 1
        live = {k for k in live if at < fits[k].rounds and not _over(state.errors[k], fits[k].patience)}
        live = {k for k in live if not fits[k].follow or not live.isdisjoint(fits[k].follow)}
        if at % KEEP == 0 and live:
            state.keep()
    grown = []
    for group in _groups([(k, seed, Tree.of(fits[k].depth)) for k, seed in forests], state):
        state.grow(group)
        grown += group
    for k, _, tree in grown:
        state.trees[k].append(tree)
    if any(state.held):  # the error after the last trees
        state.sums([], 0)
        state.record()
    out = []
    for k, fit in enumerate(fits):
        errors = state.errors[k]
        # Rounds of other fits go on; forests are judged whole.
        errors = errors[: len(state.trees[k]) + 1] if not fit.forest else errors[-1:]
        out.append(Ensemble(features, splits, state.trees[k], state.base[k], fit.loss, errors))
    return out


def _groups(growing: list, state: _Growth) -> list[list]:
    """Trees whose sums fit in one aggregate."""
    if not growing:
        return []
    deepest = max(state.fits[k].depth for k, _, _ in growing)
    size = max(1, CELLS // (2 ** (deepest - 1) * state.width * (BINS + 1)))
    return [growing[i : i + size] for i in range(0, len(growing), size)]


def _over(errors: list[float], patience: int | None) -> bool:
    return patience is not None and len(errors) - 1 - int(np.argmin(errors)) >= patience if errors else False


def best_round(errors: Sequence[float]) -> int:
    """The least number of trees with the least held-out error, one at least."""
    return max(1, int(np.argmin(errors)))
