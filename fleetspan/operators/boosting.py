"""Boosted trees by histograms, with a branch for missing values: many models on masks of the same rows are grown at once.

A member of at most TASK_ROWS rows is grown by one task, all members side by side; with more rows, each level of all members' trees is one aggregation. Both give the same trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspan.sources.files import deleted, shared

#: How the trees are grown.
RATE, LEAVES, LEAST_ROWS, RIDGE, LEAST_HESSIAN = 0.05, 31, 1000, 10.0, 1e-3
#: Bins of a feature's values; missing ones have a bin of their own after them.
BINS, MISSING = 255, 255
#: Gradients are summed as whole multiples of this share, so sums don't hang on the order or number of partitions.
UNIT = 1 / (1 << 26)
#: Trees after which the rows' scores are written anew.
SAVED_EVERY = 10
#: Rows of a member, up to which one task grows it: a byte a feature and some 65 more for each.
TASK_ROWS = 1 << 22
#: Rows that are added to a histogram at once. Their hessians (2^24 units each at most) sum to less than COUNTED, so a whole number of a double's 53 bits holds that sum and the count.
PART, COUNTED = 1 << 13, 1 << 38

HISTOGRAM = "member int, node int, feature int, bin int, g long, h long, n long"
GROWN = "member int, number int, f array<int>, b array<int>, m array<int>, l array<int>, r array<int>, v array<double>"
SPLITS = "member int, node int, feature int, gain double, bin int, missing_left boolean, g long, h long, n long, gl long, hl long, nl long"


@dataclass(frozen=True)
class Member:
    """A model: it learns from rows of these days whose label isn't null, and judges those of all other days, or of the days given."""

    name: str
    days: frozenset[str]
    label: str
    judges: frozenset[str] | None = None


@dataclass
class Node:
    g: int = 0
    h: int = 0
    n: int = 0
    split: tuple | None = None  # gain, feature, bin, missing_left, sums of the left side
    known: bool = False
    left: int = -1
    right: int = -1
    place: int = 1  # children of the node at i are at 2 i and 2 i + 1; parts equal gains, whichever was tried first


@dataclass
class Tree:
    """A tree being grown, with more splits than it will keep: those that may be needed next are tried at once."""

    nodes: list[Node] = field(default_factory=lambda: [Node()])
    kept: set[int] = field(default_factory=set)

    def arrays(self, kept: bool) -> dict[str, np.ndarray]:
        inner = [i for i, x in enumerate(self.nodes) if x.left >= 0 and (not kept or i in self.kept)]
        f = np.full(len(self.nodes), -1, np.int32)
        b, m, left, right = (np.zeros(len(self.nodes), np.int32) for _ in range(4))
        for i in inner:
            x = self.nodes[i]
            f[i], b[i], m[i], left[i], right[i] = x.split[1], x.split[2], x.split[3], x.left, x.right
        return {"f": f, "b": b, "m": m, "l": left, "r": right}

    def grow(self, leaves: int, ahead: bool = True) -> list[int]:
        """Keeps the best splits first; nodes whose histograms are needed to go on (and, ahead, those that may be needed next), or none if the tree is done."""
        if not self.nodes[0].known:
            return [0]
        self.kept, heap, asked = set(), [], []

        def push(i: int) -> None:
            if self.nodes[i].split:
                heapq.heappush(heap, (-self.nodes[i].split[0], self.nodes[i].place, i))

        push(0)
        while heap and len(self.kept) + 1 < leaves:
            i = heapq.heappop(heap)[2]
            if self.nodes[i].left < 0:  # what becomes of its sides must be known; the next best are tried in the same pass
                for j in [i, *[j for *_, j in heapq.nsmallest(leaves - 2 - len(self.kept), heap) if ahead]]:
                    if self.nodes[j].left < 0:
                        self.nodes[j].left, self.nodes[j].right = len(self.nodes), len(self.nodes) + 1
                        self.nodes += [Node(place=2 * self.nodes[j].place), Node(place=2 * self.nodes[j].place + 1)]
                        asked += [self.nodes[j].left, self.nodes[j].right]
                return asked
            self.kept.add(i)
            push(self.nodes[i].left)
            push(self.nodes[i].right)
        return []

    def values(self, rate: float, ridge: float) -> np.ndarray:
        return np.array([-rate * x.g * UNIT / (x.h * UNIT + ridge) for x in self.nodes])


def placed(bins: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The node at which each row of bins ends."""
    at, rows = np.zeros(len(bins), np.int32), np.arange(len(bins))
    while True:
        f = tree["f"][at]
        going = f >= 0
        if not going.any():
            return at
        x = bins[rows, np.maximum(f, 0)]
        left = np.where(x == MISSING, tree["m"][at] == 1, x <= tree["b"][at])
        at = np.where(going, np.where(left, tree["l"][at], tree["r"][at]), at)


def histogram(x: np.ndarray, g: np.ndarray, counted: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of gradients, of hessians and of rows by feature and bin, as whole numbers. x: bins by feature; counted: hessians with COUNTED added."""
    out = np.zeros((len(x), 256, 3))
    for i in range(0, len(rows), PART):
        part = rows[i : i + PART]
        mine, both = g.take(part), counted.take(part)
        for f, bins in enumerate(x):
            key = bins.take(part).astype(np.intp)
            sums = np.bincount(key, both, 256)
            n = np.floor(sums / COUNTED)
            out[f, :, 0] += np.bincount(key, mine, 256)
            out[f, :, 1] += sums - n * COUNTED
            out[f, :, 2] += n
    return out.astype(np.int64)


def grown(x: np.ndarray, y: np.ndarray, raw: np.ndarray, trees: int, rate: float, leaves: int, least_rows: int, ridge: float) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Trees, and their nodes' values, of one member whose rows are all here: bins by feature, labels, and scores so far, which are added to."""
    every = np.arange(len(y), dtype=np.int32)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, counted = np.rint((p - y) / UNIT), np.rint(p * (1 - p) / UNIT) + COUNTED
        tree, rows, sums = Tree(), {0: every}, {}
        while asked := tree.grow(leaves, ahead=False):
            if asked == [0]:
                sums[0] = histogram(x, g, counted, every)
            else:
                i = next(i for i, node in enumerate(tree.nodes) if node.left == asked[0])
                _, f, at, missing_left = tree.nodes[i].split
                mine = rows.pop(i)
                bins = x[f].take(mine)
                left = (bins <= at) | ((bins == MISSING) & bool(missing_left))
                rows |= {asked[0]: mine[left], asked[1]: mine[~left]}
                few, many = sorted(asked, key=lambda k: len(rows[k]))
                sums[few] = histogram(x, g, counted, rows[few])
                sums[many] = sums.pop(i) - sums[few]
            gain, at, missing_left, *_ = best_splits(np.stack([sums[i] for i in asked]), least_rows, ridge)
            for i, f, best in zip(asked, gain.argmax(1).tolist(), gain.max(1).tolist(), strict=True):
                node, k = tree.nodes[i], asked.index(i)
                node.g, node.h, node.n = (int(v) for v in sums[i][0].sum(0))
                node.known, node.split = True, (best, f, int(at[k, f]), int(missing_left[k, f])) if best > 0 else None
        values = tree.values(rate, ridge)
        for i, mine in rows.items():
            raw[mine] += values[i]
        yield tree.arrays(True), values


def edges_of(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper bounds of each feature's bins, by one aggregation; values above the last are in one bin more."""
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    one = rows.agg(*[F.percentile_approx(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), shares, 10_000).alias(c) for c in names]).first()
    return [sorted(set(one[c] or [])) for c in names]


def _unpacked(batch: pa.RecordBatch, features: int, labels: int, members: int) -> tuple[np.ndarray, ...]:
    """day numbers, bins, labels (-1: none) and scores of a batch."""
    n = batch.num_rows
    part = lambda i, kind, width: np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(n, width)
    return batch.column(0).to_numpy(zero_copy_only=False), part(1, np.uint8, features), part(2, np.int8, labels), part(3, np.float64, members)


def blocks(b: pa.RecordBatch, shape: tuple[int, int, int], masks: np.ndarray, label: list[int], since: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each member its number, and bins, labels and scores of those rows of a batch that are in its mask and have its label."""
    d, x, y, raw = _unpacked(b, *shape)
    for j, trees in enumerate(since):
        mine = masks[j][d] & (y[:, label[j]] >= 0)
        if mine.any():
            bins = x[mine]
            yield j, bins, y[mine, label[j]], scored(raw[mine, j : j + 1], bins, [trees])[:, 0]


def scored(raw: np.ndarray, x: np.ndarray, since: list[list[tuple[dict, np.ndarray]]]) -> np.ndarray:
    """Scores of rows by member after the trees that they don't hold yet."""
    out = raw.copy()
    for j, trees in enumerate(since):
        for tree, values in trees:
            out[:, j] += values[placed(x, tree)]
    return out


class Booster:
    """Members grown together on one table of binned rows."""

    def __init__(self, rows: DataFrame, names: list[str], members: list[Member], rate: float = RATE, leaves: int = LEAVES, least_rows: int = LEAST_ROWS, ridge: float = RIDGE, bins: int = BINS, binned_by: DataFrame | None = None):
        """binned_by: rows whose quantiles are the bins, if not all."""
        self.names, self.members, self.labels = names, members, list(dict.fromkeys(m.label for m in members))
        self.rate, self.leaves, self.least_rows, self.ridge = rate, leaves, least_rows, ridge
        self.days = sorted(str(r[0]) for r in rows.select(F.col("day").cast("string")).distinct().collect())
        self.edges = edges_of(rows if binned_by is None else binned_by, names, bins)
        inside = lambda m: F.col("day").cast("string").isin(*m.days) & F.col(m.label).isNotNull()
        own = [F.when(inside(m), F.col(m.label).cast("double")) for m in members]
        base = rows.agg(*[F.avg(c).alias(f"b{i}") for i, c in enumerate(own)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(own)]).first()
        self.most_rows = max(base[len(members) :], default=0)  # of a member
        share = np.clip(np.array([0.5 if x is None else x for x in base[: len(members)]], float), 1e-9, 1 - 1e-9)
        self.baseline = np.log(share / (1 - share))
        self.trees: list[list[dict]] = [[] for _ in members]  # f, t, m, l, r, v
        self.since: list[list[tuple[dict, np.ndarray]]] = [[] for _ in members]  # trees that the saved scores don't hold yet
        self.state = shared(self._binned(rows), "boosting")

    def _binned(self, rows: DataFrame) -> DataFrame:
        """day number, x (a byte a feature), y (a byte a label) and raw (a double a member) of each row."""
        day = F.array_position(F.array(*map(F.lit, self.days)), F.col("day").cast("string")).cast("int") - 1
        given = rows.select(day.alias("d"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.names)], *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(f"y{i}") for i, c in enumerate(self.labels)])
        edges, n, start = [np.array(e) for e in self.edges], len(self.names), self.baseline.astype(np.float64).tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.empty((b.num_rows, n), np.uint8)
                for i, e in enumerate(edges):
                    v = b.column(1 + i).to_numpy(zero_copy_only=False).astype(float)
                    x[:, i] = np.where(np.isnan(v), MISSING, np.searchsorted(e, v))
                y = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1 + n :]], 1).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, y)], pa.array([start] * b.num_rows, pa.binary())], names=["d", "x", "y", "raw"])

        return given.mapInArrow(run, "d int, x binary, y binary, raw binary")

    def _masks(self) -> np.ndarray:
        return np.array([[d in m.days for d in self.days] for m in self.members])

    def histograms(self, trees: list[Tree], asked: list[list[int]]) -> DataFrame:
        """HISTOGRAM of the nodes asked for, of all members, in one pass over the rows."""
        masks, label = self._masks(), [self.labels.index(m.label) for m in self.members]
        grown = [t.arrays(False) for t in trees]
        shape = (len(self.names), len(self.labels), len(self.members))
        since = self.since

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {j: np.zeros((len(nodes), shape[0], 256, 3), np.int64) for j, nodes in enumerate(asked) if nodes}
            for b in batches:
                d, x, y, raw = _unpacked(b, *shape)
                raw = scored(raw, x, since)
                for j, sums in total.items():
                    mine = masks[j][d] & (y[:, label[j]] >= 0)
                    if not mine.any():
                        continue
                    bins = x[mine]
                    local = np.full(len(trees[j].nodes), -1)
                    local[asked[j]] = np.arange(len(asked[j]))
                    node = local[placed(bins, grown[j])]
                    there = node >= 0
                    p = 1 / (1 + np.exp(-raw[mine, j][there]))
                    g, h = np.rint((p - y[mine, label[j]][there]) / UNIT), np.rint(p * (1 - p) / UNIT)
                    for i in range(shape[0]):
                        key = node[there] * 256 + bins[there, i]
                        for k, w in enumerate((g, h, None)):
                            sums[:, i, :, k] += np.bincount(key, w, len(asked[j]) * 256).astype(np.int64).reshape(-1, 256)
            for j, sums in total.items():
                at = np.nonzero(sums[..., 2])
                if len(at[0]):
                    keys = [np.full(len(at[0]), j), np.array(asked[j])[at[0]], at[1], at[2]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(k.astype(np.int32)) for k in keys], *[pa.array(sums[..., k][at]) for k in range(3)]], names=["member", "node", "feature", "bin", "g", "h", "n"])

        sums = self.state.mapInArrow(run, HISTOGRAM)
        return sums.groupBy("member", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])

    def splits(self, histograms: DataFrame) -> DataFrame:
        """SPLITS: the best split of each node and feature (gain null if there is none), found where its histogram lies; the driver gets a row a feature."""
        least_rows, ridge = self.least_rows, self.ridge
        rows = histograms.groupBy("member", "node", "feature").agg(F.sort_array(F.collect_list(F.struct("bin", "g", "h", "n"))).alias("bins"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from fleetspan.operators.boosting import best_split  # by name, so that workers import it

            for b in batches:
                out = [(*key, *best_split(bins, least_rows, ridge)) for *key, bins in zip(*[c.to_pylist() for c in b.columns], strict=True)]
                if out:
                    kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.bool_()] + [pa.int64()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SPLITS.split(", ")])

        return rows.mapInArrow(run, SPLITS)

    def add_tree(self) -> None:
        """One more tree for every member."""
        trees = [Tree() for _ in self.members]
        while any(asked := [t.grow(self.leaves) for t in trees]):
            best: dict[tuple[int, int], tuple] = {}
            for r in self.splits(self.histograms(trees, asked)).collect():
                node = trees[r.member].nodes[r.node]
                node.g, node.h, node.n = r.g, r.h, r.n
                if r.gain is not None and (r.gain, -r.feature) > best.get((r.member, r.node), (0.0, 0))[:2]:
                    best[r.member, r.node] = (r.gain, -r.feature, r.bin, r.missing_left)
            for j, nodes in enumerate(asked):
                for i in nodes:
                    node, found = trees[j].nodes[i], best.get((j, i))
                    node.known, node.split = True, found and (found[0], -found[1], found[2], int(found[3]))
        for j, tree in enumerate(trees):
            values, kept = tree.values(self.rate, self.ridge), tree.arrays(True)
            self.since[j].append((kept, values))
            self.trees[j].append(self._stored(kept, values))
        if len(self.since[0]) >= SAVED_EVERY:
            self._save()

    def add_trees(self, trees: int) -> None:
        """More trees for every member, each member's in one task, which gets all its rows."""
        shape, masks, since = (len(self.names), len(self.labels), len(self.members)), self._masks(), self.since
        label, how = [self.labels.index(m.label) for m in self.members], (self.rate, self.leaves, self.least_rows, self.ridge)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for j, *own in blocks(b, shape, masks, label, since):
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in own]], names=["member", "x", "y", "raw"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from fleetspan.operators.boosting import grown  # by name, so that workers import it

            held = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            for j in sorted({r[0] for r in held}):
                x, y, raw = (np.concatenate([np.frombuffer(r[k], kind) for r in held if r[0] == j]) for k, kind in ((1, np.uint8), (2, np.int8), (3, np.float64)))
                x = np.ascontiguousarray(x.reshape(len(y), -1).T)
                if {r[0] for r in held} == {j}:
                    held.clear()
                for number, (tree, values) in enumerate(grown(x, y, raw, trees, *how)):
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([number], pa.int32()), *[pa.array([tree[c].tolist()], pa.list_(pa.int32())) for c in "fbmlr"], pa.array([values.tolist()], pa.list_(pa.float64()))], names=["member", "number", *"fbmlrv"])

        parts = self.state.mapInArrow(dealt, "member int, x binary, y binary, raw binary").repartitionById(len(self.members), "member")
        found = {(r.member, r.number): r for r in parts.mapInArrow(run, GROWN).collect()}  # at most 2 * leaves numbers a column
        none = Tree()
        for j in range(len(self.members)):
            for number in range(trees):
                r = found.get((j, number))
                tree, values = ({c: np.array(r[c], np.int32) for c in "fbmlr"}, np.array(r.v)) if r else (none.arrays(True), none.values(self.rate, self.ridge))
                self.since[j].append((tree, values))
                self.trees[j].append(self._stored(tree, values))

    def _stored(self, tree: dict[str, np.ndarray], values: np.ndarray) -> dict:
        """The parallel lists of a tree: only the nodes that rows can reach."""
        order, queue = {}, [0]
        while queue:
            i = queue.pop(0)
            order[i] = len(order)
            if tree["f"][i] >= 0:
                queue += [int(tree["l"][i]), int(tree["r"][i])]
        inner = lambda i: tree["f"][i] >= 0
        upper = lambda f, b: self.edges[f][b] if b < len(self.edges[f]) else float("inf")  # noqa: E731  the last bin is open: such a split parts all values from missing ones
        return {
            "f": [int(tree["f"][i]) for i in order], "t": [upper(tree["f"][i], tree["b"][i]) if inner(i) else 0.0 for i in order], "m": [int(tree["m"][i]) for i in order],
            "l": [order[int(tree["l"][i])] if inner(i) else 0 for i in order], "r": [order[int(tree["r"][i])] if inner(i) else 0 for i in order], "v": [0.0 if inner(i) else float(values[i]) for i in order],
        }

    def _with_scores(self) -> DataFrame:
        shape, since = (len(self.names), len(self.labels), len(self.members)), self.since

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, x, _, raw = _unpacked(b, *shape)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in scored(raw, x, since)], pa.binary())], names=["d", "x", "y", "raw"])

        return self.state.mapInArrow(run, "d int, x binary, y binary, raw binary")

    def _save(self) -> None:
        old, self.state = self.state, shared(self._with_scores(), "boosting")
        deleted(old)
        self.since = [[] for _ in self.members]

    def fit(self, trees: int) -> Booster:
        if self.most_rows <= TASK_ROWS and len(self.trees[0]) < trees:
            self.add_trees(trees - len(self.trees[0]))
        while len(self.trees[0]) < trees:
            self.add_tree()
        return self

    def model(self, member: int, trees: int | None = None) -> dict:
        return {"features": self.names, "baseline": float(self.baseline[member]), "trees": self.trees[member][:trees]}

    def judged(self, outside: bool = True, at: list[int] | None = None) -> DataFrame:
        """member, day, y and p of all rows that have the member's label: of days that it judges, or of those that it has learned from. at: with a column trees, after each of these counts of trees,
        none of which may be below those that the saved scores hold.
        """
        shape, since, label = (len(self.names), len(self.labels), len(self.members)), self.since, [self.labels.index(m.label) for m in self.members]
        judges = lambda m, d: (d not in m.days if m.judges is None else d in m.judges) if outside else d in m.days
        masks, done = np.array([[judges(m, d) for d in self.days] for m in self.members]), len(self.trees[0])
        counts = sorted(set(at or [done]))
        saved = done - len(since[0])
        if counts[0] < saved or counts[-1] > done:
            raise ValueError(f"Scores are known after {saved} to {done} trees.")
        steps = list(zip([saved, *counts], counts, strict=False))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                day = b.column(0).to_numpy(zero_copy_only=False)
                labels = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(len(day), -1)
                for j, bins, y, raw in blocks(b, shape, masks, label, [[] for _ in since]):
                    d = day[masks[j][day] & (labels[:, label[j]] >= 0)]
                    for before, count in steps:
                        raw = scored(raw[:, None], bins, [since[j][before - saved : count - saved]])[:, 0]
                        columns = [np.full(len(y), j, np.int32), d.astype(np.int32), y.astype(np.int32), 1 / (1 + np.exp(-raw)), np.full(len(y), count, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["member", "d", "y", "p", "trees"])

        rows = self.state.mapInArrow(run, "member int, d int, y int, p double, trees int")
        return rows.select("member", F.get(F.array(*map(F.lit, self.days)), F.col("d")).alias("day"), "y", "p", *["trees"] * (at is not None))

    def measured(self, counts: list[int]) -> DataFrame:
        """trees, member, ap, n and positives: average precision on the rows that each member judges, after each of these counts of trees, which rise."""
        from fleetspan.operators.models import average_precision

        keys = ["trees", "member"]
        if self.most_rows <= TASK_ROWS:
            return shared(average_precision(self.fit(counts[-1]).judged(at=counts), keys), "measured")
        each = [shared(average_precision(self.fit(n).judged(at=[n]), keys), "measured") for n in counts]
        return reduce(DataFrame.unionByName, each)


def best_splits(sums: np.ndarray, least_rows: int, ridge: float) -> tuple[np.ndarray, ...]:
    """gain (0 if no split leaves least_rows on both sides and gains anything), bin, missing_left, and sums of the left side, of the best split of each node and feature; sums: (node, feature, bin, 3)."""
    values, missing = sums[:, :, :MISSING], sums[:, :, MISSING:]
    below = values.cumsum(2)
    total = below[:, :, -1:] + missing
    worth = lambda s: (s[..., 0] * UNIT) ** 2 / (s[..., 1] * UNIT + ridge)
    gains, lefts = [], []
    for missing_left in (False, True):
        left = below + missing * missing_left
        right = total - left
        good = (values[..., 2] > 0) & (right[..., 2] > 0)
        if missing_left:
            good &= missing[..., 2] > 0
        for side in (left, right):
            good &= (side[..., 2] >= least_rows) & (side[..., 1] * UNIT >= LEAST_HESSIAN)
        gains.append(np.where(good, worth(left) + worth(right) - worth(total), 0.0))
        lefts.append(left)
    gain, at = np.stack([x.max(2) for x in gains]), np.stack([x.argmax(2) for x in gains])
    missing_left = gain[1] > gain[0]
    best = np.where(missing_left, at[1], at[0])
    side = np.take_along_axis(np.where(missing_left[..., None, None], lefts[1], lefts[0]), best[..., None, None], 2)[:, :, 0]
    right = total[:, :, 0] - side
    goes = np.where(missing[:, :, 0, 2] > 0, missing_left, side[..., 2] > right[..., 2])  # where none was missing, with the more
    return np.maximum(gain.max(0), 0.0), best, goes, side


def best_split(bins: list[dict], least_rows: int, ridge: float) -> tuple:
    """gain, bin, missing_left, and sums of gradients, hessians and rows of all and of the left side, of one node's feature; gain is None if there is no split."""
    sums = np.zeros((1, 1, 256, 3), np.int64)
    for b in bins:
        sums[0, 0, b["bin"]] = b["g"], b["h"], b["n"]
    total = sums[0, 0].sum(0).tolist()
    gain, at, missing_left, side = (x[0, 0] for x in best_splits(sums, least_rows, ridge))
    return (float(gain), int(at), bool(missing_left), *total, *side.tolist()) if gain > 0 else (None, 0, False, *total, 0, 0, 0)


def choose_count(rows: DataFrame, names: list[str], days: list[str], label: str, most: int, step: int, **how) -> tuple[int, list[float], Booster]:
    """(best number of trees, mean average precision at each multiple of step, booster): each day is judged by a model that hasn't seen it; one more member, the last, learns from all days
    and judges the others. The booster's `stages` has what measured() gives of all counts.
    """
    given = frozenset(days)
    members = [Member(d, given - {d}, label, frozenset([d])) for d in days] + [Member("all", given, label)]
    booster = Booster(rows, names, members, binned_by=rows.where(F.col("day").cast("string").isin(*days)), **how)
    counts = list(range(step, most + 1, step))
    booster.stages = booster.measured(counts)
    found = {r.trees: r.ap for r in booster.stages.where(F.col("member") < len(days)).groupBy("trees").agg(F.avg("ap").alias("ap")).collect()}
    curve = [found.get(n) or 0.0 for n in counts]
    return counts[int(np.argmax(curve))], curve, booster
