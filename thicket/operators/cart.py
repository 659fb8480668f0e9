"""Decision trees on presence, with class importances, cost-complexity pruning, and selection by folds or bound."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from statistics import pvariance

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import counted
from ..sources.views import spread
from .matrix import Problem
from .scm import columns, compression_set, guarded, least, spelled


@dataclass
class Node:
    rows: list[int]
    counts: list[int]
    depth: int
    feature: str | None = None
    left: Node | None = None  # has the feature
    right: Node | None = None

    @property
    def leaf(self) -> bool:
        return self.left is None

    def leaves(self) -> list[Node]:
        return [x for x in self.walk() if x.leaf]

    def walk(self) -> list[Node]:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            out.append(x)
            todo += [] if x.leaf else [x.right, x.left]
        return out

    def copy(self) -> Node:
        return Node(self.rows, self.counts, self.depth, self.feature, *(None if x is None else x.copy() for x in (self.left, self.right)))


class Priors:
    """Altered priors over the class sizes of the training rows; a class without rows has none."""

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        w = weights or [1.0] * len(totals)
        m = sum(totals)
        share = [w[c] * t / m for c, t in enumerate(totals)]
        self.per_row = [s / sum(share) / t if t else 0.0 for s, t in zip(share, totals, strict=True)]

    def joint(self, counts: list[int]) -> list[float]:
        return [a * n for a, n in zip(self.per_row, counts, strict=True)]

    def p(self, node: Node) -> float:
        return sum(self.joint(node.counts))

    def given(self, node: Node) -> list[float]:
        """p(c|t) of each class."""
        j = self.joint(node.counts)
        return [x / sum(j) for x in j]

    def predicted(self, node: Node) -> int:
        j = self.joint(node.counts)
        return j.index(max(j))

    def risk(self, node: Node) -> float:
        """R(t) = r(t) p(t)."""
        j = self.joint(node.counts)
        return sum(j) - max(j)

    def impurity(self, node: Node, criterion: str) -> float:
        j = self.joint(node.counts)
        t = sum(j)
        q = [x / t for x in j]
        return sum(a * (1 - a) for a in q) if criterion == "gini" else -sum(a * math.log(a) for a in q if a)


def weighed(counts: Column, weight: Column, entropy: Column) -> Column:
    """p(t) i(t) of a node from its counts by class; 0 for an empty one. Sums go in the order of classes."""
    joint = F.zip_with(weight, counts, lambda w, n: w * n)
    zero = F.lit(0.0)
    t = F.aggregate(joint, zero, lambda a, j: a + j)
    gini = F.when(t == 0, zero).otherwise(t - F.aggregate(joint, zero, lambda a, j: a + j * j) / F.when(t == 0, 1.0).otherwise(t))
    return F.when(entropy, F.aggregate(joint, zero, lambda a, j: a + F.when(j == 0, zero).otherwise(-j * F.ln(F.when(j == 0, 1.0).otherwise(j / t))))).otherwise(gini)


STATES = "job int, node int, masks array<array<bigint>>, train array<bigint>, totals array<bigint>, weight array<double>, entropy boolean"


def scores_of(p: Problem, states: list[tuple], source: DataFrame) -> DataFrame:
    """job, node, feature, score, occurrences: open nodes of any trees in one scan, masks being data; splits with an empty side are left out."""
    df = source.select("feature", "words").crossJoin(F.broadcast(source.sparkSession.createDataFrame(states, STATES)))  # a row an open node
    df = df.select("job", "node", "feature", "totals", "weight", "entropy", counted("words", F.col("train")).alias("occurrences"), F.transform("masks", lambda m: counted("words", m)).alias("l"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n)
    df = df.where((total("l") > 0) & (total("l") < total("totals")))
    right = F.zip_with("totals", "l", lambda n, m: n - m)
    score = weighed(F.col("l"), F.col("weight"), F.col("entropy")) + weighed(right, F.col("weight"), F.col("entropy"))
    return df.select("job", "node", "feature", F.round(score, 12).alias("score"), "occurrences")


def state(p: Problem, job: int, node: int, x: Node, priors: Priors, criterion: str, train: list[int]) -> tuple:
    by_class = [p.mask([i for i in x.rows if p.labels[i] == c]) for c in range(len(priors.per_row))]
    return job, node, by_class, train, x.counts, priors.per_row, criterion != "gini"


def split_scores(p: Problem, nodes: list[Node], priors: Priors, criterion: str, train: list[int], source: DataFrame | None = None) -> DataFrame:
    """node, feature, score, occurrences of the nodes of one tree."""
    mask = p.mask(train)
    return scores_of(p, [state(p, 0, k, x, priors, criterion, mask) for k, x in enumerate(nodes)], p.patterns if source is None else source).drop("job")


def best_splits(scores: DataFrame) -> DataFrame:
    """job, node, feature, score: least score, then most occurrences, then first name."""
    return scores.groupBy("job", "node").agg(F.expr("min(struct(score, -occurrences as o, feature)) as x")).selectExpr("job", "node", "x.feature", "x.score")


@dataclass
class Growth:
    """What a tree is grown from."""

    rows: list[int]
    criterion: str = "gini"
    max_depth: int = 10
    min_split: int = 2
    weights: list[float] | None = None

    def __post_init__(self):
        self.criterion = {"crossentropy": "cross-entropy"}.get(self.criterion, self.criterion)
        if self.criterion not in ("gini", "cross-entropy") or self.max_depth < 1 or self.min_split < 2:
            raise ValueError("criterion is gini or cross-entropy, max_depth at least 1, min_split at least 2")

    def open(self, x: Node) -> bool:
        return x.depth < self.max_depth and len(x.rows) >= self.min_split and sum(n > 0 for n in x.counts) > 1


def grow_all(p: Problem, jobs: list[Growth], blacklist: DataFrame | None = None, classes: int | None = None, on_level=None, on_split=None) -> tuple[list[tuple[Node, Priors]], dict[str, int]]:
    """The trees of all jobs, and the columns of their features. A level of all trees is one scan.

    on_split(node) is told of each split, on_level(depth, nodes) of each level that has been split.
    """
    c = classes or max(p.labels) + 1
    count = lambda rows: [sum(n) for n in zip(*([p.labels[i] == k for k in range(c)] for i in rows), strict=True)] if rows else [0] * c
    roots = [Node(j.rows, count(j.rows), 0) for j in jobs]
    priors, masks = [Priors(x.counts, j.weights) for x, j in zip(roots, jobs, strict=True)], [p.mask(j.rows) for j in jobs]
    source, cols, level = spread(p.without(blacklist)[1]), {}, list(enumerate(roots))  # few features are many words, once there are many examples
    while level := [(j, x) for j, x in level if jobs[j].open(x)]:
        states = [state(p, j, k, x, priors[j], jobs[j].criterion, masks[j]) for k, (j, x) in enumerate(level)]
        found = {r.node: r.feature for r in best_splits(scores_of(p, states, source)).collect()}
        cols |= columns(p, [f for f in found.values() if f not in cols])
        after = []
        for k, (j, x) in enumerate(level):
            if k in found:
                x.feature = found[k]
                has = lambda i, f=x.feature: cols[f] >> (p.n - 1 - i) & 1
                x.left, x.right = (Node(s, count(s), x.depth + 1) for s in ([i for i in x.rows if has(i)], [i for i in x.rows if not has(i)]))
                after += [(j, x.left), (j, x.right)]
                if on_split:
                    on_split(x)
        if on_level:
            on_level(level[0][1].depth + 1, [x for _, x in after])
        level = after
    return list(zip(roots, priors, strict=True)), cols


def grow(p: Problem, train: list[int] | None = None, criterion: str = "gini", max_depth: int = 10, min_split: int = 2, weights: list[float] | None = None, blacklist: DataFrame | None = None, classes: int | None = None, on_level=None, on_split=None) -> tuple[Node, Priors]:
    rows = list(range(p.n)) if train is None else train
    return grow_all(p, [Growth(rows, criterion, max_depth, min_split, weights)], blacklist, classes, on_level, on_split)[0][0]


def equivalents(p: Problem, root: Node, priors: Priors, criterion: str, train: list[int], most: int = 10_000, seed: int = 0, blacklist: DataFrame | None = None) -> list[list[str]]:
    """For each inner node, in the order of walk(), the features that split it as well and are in as many examples: one scan for all nodes. Of more than most, seed draws."""
    inner = [x for x in root.walk() if not x.leaf]
    if not inner:
        return []
    every = p.without(blacklist)[0]
    scores = split_scores(p, inner, priors, {"crossentropy": "cross-entropy"}.get(criterion, criterion), train, every)
    top = scores.groupBy("node").agg(F.expr("min(struct(score, -occurrences as o)) as x")).selectExpr("node", "x.score", "-x.o as occurrences")
    ties = scores.join(F.broadcast(top), ["node", "score", "occurrences"]).select("node", "feature").persist()  # a row a node
    out = []
    for k in range(len(inner)):
        own = ties.where(F.col("node") == k).orderBy(F.xxhash64("feature", F.lit(seed)), "feature").limit(most)
        out.append(sorted(r.feature for r in own.collect()))
    ties.unpersist()
    return out


def importances(root: Node, priors: Priors, criterion: str) -> dict[str, float]:
    """Decrease of impurity by feature, to a sum of 1."""
    out: dict[str, float] = {}
    weighed = lambda x: priors.p(x) * priors.impurity(x, criterion)
    for x in root.walk():
        if not x.leaf:
            out[x.feature] = out.get(x.feature, 0.0) + weighed(x) - weighed(x.left) - weighed(x.right)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()} if total else out


def prune_sequence(root: Node, priors: Priors) -> list[tuple[float, Node]]:
    """(alpha, tree) of minimal cost-complexity pruning, from the smallest tree of full accuracy to the root alone."""
    tree = root.copy()
    changed = True
    while changed:
        changed = False
        for x in tree.walk():
            if not x.leaf and x.left.leaf and x.right.leaf and math.isclose(priors.risk(x), priors.risk(x.left) + priors.risk(x.right), rel_tol=1e-5, abs_tol=1e-8):
                x.left = x.right = x.feature = None
                changed = True
    out = [(0.0, tree.copy())]
    while not tree.leaf:
        weak = [(x, (priors.risk(x) - sum(map(priors.risk, leaves))) / (len(leaves) - 1)) for x in tree.walk() if not x.leaf for leaves in [x.leaves()]]
        least = min(g for _, g in weak)
        for x, g in weak:
            if math.isclose(g, least, rel_tol=1e-5, abs_tol=1e-8):
                x.left = x.right = x.feature = None
        out.append((least, tree.copy()))
    last: dict[float, Node] = {}
    for a, t in out:
        last[a] = t
    return list(last.items())


def predict(root: Node, priors: Priors, cols: dict[str, int], n: int, rows: list[int]) -> dict[int, int]:
    """The class of each row; rows go down the tree together, one look at a column a node."""
    out, todo = {}, [(root, np.asarray(rows, int))]
    while todo:
        x, own = todo.pop()
        if x.leaf:
            out |= dict.fromkeys(own.tolist(), priors.predicted(x))
        elif len(own):
            has = spelled(cols[x.feature], n)[own] == 1
            todo += [(x.left, own[has]), (x.right, own[~has])]
    return out


def leaf_of(x: Node, cols: dict[str, int], n: int, i: int) -> Node:
    while not x.leaf:
        x = x.left if cols[x.feature] >> (n - 1 - i) & 1 else x.right
    return x


def choose(x: Node, have: Column, at: Callable[[Node], Column]) -> Column:
    """What at() gives for the leaf that a row's features lead to."""
    return at(x) if x.leaf else F.when(F.array_contains(have, F.lit(x.feature)), choose(x.left, have, at)).otherwise(choose(x.right, have, at))


def expression(root: Node, priors: Priors, have: str = "have") -> Column:
    """The class as a column over an array of the features that a row has; features are literals, whatever their letters."""
    return choose(root, F.col(have), lambda x: F.lit(priors.predicted(x)))


def probabilities(root: Node, priors: Priors, have: str = "have") -> Column:
    """p(c|t) of the leaf, an array by class."""
    return choose(root, F.col(have), lambda x: F.array(*map(F.lit, priors.given(x))))


def case_sql(x: Node, priors: Priors, have: str = "have") -> str:
    """The tree as SQL, for what takes no columns; quotes and backslashes of features are escaped."""
    if x.leaf:
        return str(priors.predicted(x))
    feature = x.feature.replace("\\", "\\\\").replace("'", "\\'")
    return f"case when array_contains({have}, '{feature}') then {case_sql(x.left, priors, have)} else {case_sql(x.right, priors, have)} end"


class DecisionTree:
    """A learner of fixed settings, as an object; grow() is the function behind it."""

    def __init__(self, criterion: str = "gini", max_depth: int = 10, min_samples_split: int = 2, class_importance: list[float] | None = None):
        self.criterion, self.max_depth, self.min_split, self.weights, self.tree = criterion, max_depth, min_samples_split, class_importance, None

    def fit(self, p: Problem, train: list[int] | None = None, **options) -> DecisionTree:
        self.tree = grow(p, train, self.criterion, self.max_depth, self.min_split, self.weights, **options)
        return self

    def __len__(self) -> int:
        return sum(not x.leaf for x in guarded(self.tree)[0].walk())

    @property
    def depth(self) -> int:
        return max(x.depth for x in guarded(self.tree)[0].walk())

    @property
    def rule_importances(self) -> dict[str, float]:
        return importances(*guarded(self.tree), {"crossentropy": "cross-entropy"}.get(self.criterion, self.criterion))

    def _leaves(self, p: Problem) -> list[Node]:
        root, _ = guarded(self.tree)
        cols = columns(p, tree_features(root))
        return [leaf_of(root, cols, p.n, i) for i in range(p.n)]

    def predict(self, p: Problem, tags: list[str] | None = None) -> list:
        """Classes, or their tags."""
        got = [guarded(self.tree)[1].predicted(x) for x in self._leaves(p)]
        return [tags[c] for c in got] if tags else got

    def predict_proba(self, p: Problem) -> list[list[float]]:
        return [guarded(self.tree)[1].given(x) for x in self._leaves(p)]


def tree_features(root: Node) -> list[str]:
    return sorted({x.feature for x in root.walk() if not x.leaf})


def tree_bound(m: int, z: int, r: int, n: int, genome_size: int, classes: int, delta: float = 0.05) -> float:
    """Sample-compression bound of a tree of n rules."""
    ln_c = lambda a, b: math.log(math.comb(a, b))
    b = ln_c(m, z) + ln_c(m - z, r) + (n * math.log(z * genome_size) if n and z else 0.0) + (n + 1) * math.log(classes) + ln_c(2 * n + 1, n)
    b += math.log(math.pi**6 * (n + 1) ** 2 * (r + 1) ** 2 * (z + 1) ** 2 / (216 * delta))
    return 1 - math.exp(-b / (m - z - r)) if m - z - r > 0 else 1.0


def risk_of(root: Node, priors: Priors, p: Problem, rows: list[int], cols: dict[str, int] | None = None) -> float:
    got = predict(root, priors, columns(p, tree_features(root)) if cols is None else cols, p.n, rows)
    return sum(got[i] != p.labels[i] for i in rows) / max(len(rows), 1)


def step_value(steps: list[tuple[float, float]], a: float) -> float:
    """The value of the last step that begins at a or before it."""
    return steps[bisect_right([x for x, _ in steps], a) - 1][1]


def looked_up(df: DataFrame, a: str, steps: list[tuple[float, float]], out: str, kind: str = "double") -> DataFrame:
    """df with the values of steps (where they begin, value), half open, at column a; rows before the first step go. The steps are few and broadcast."""
    ends = [x for x, _ in steps[1:]] + [float("inf")]
    own = df.sparkSession.createDataFrame([(x, e, v) for (x, v), e in zip(steps, ends, strict=True)], f"lo double, hi double, v {kind}")
    return df.join(F.broadcast(own.withColumnRenamed("v", out)), (F.col(a) >= F.col("lo")) & (F.col(a) < F.col("hi"))).drop("lo", "hi")


def learn_tree(p: Problem, train: list[int], folds: list[int] | None = None, criteria=("gini",), depths=(10,), min_splits=(2,), weights=(None,), selection: str = "cv", delta: float = 0.05, genome_size: int | None = None, blacklist: DataFrame | None = None, progress=None) -> tuple[Node, Priors, dict]:
    """The best pruned tree over the grid. Ties: score, size, variance of the class importances, place in the grid; a more pruned tree wins among equals of one sequence.

    The trees of all settings, and of all folds, grow in common scans. progress(share) is told how far it is, by levels of depth.
    """
    size, classes, tried = genome_size or p.features.count(), max(p.labels) + 1, []
    grid = [(c, d, s, w) for c in criteria for d in depths for s in min_splits for w in weights]
    parts = [(train, [])]
    if selection == "cv":
        parts += [([i for i, g in zip(train, folds, strict=True) if g != f], [i for i, g in zip(train, folds, strict=True) if g == f]) for f in sorted(set(folds))]
    trees, cols = grow_all(p, [Growth(inside, c, d, s, w) for c, d, s, w in grid for inside, _ in parts], blacklist, classes, on_level=progress and (lambda depth, _: progress(depth / (max(depths) + 1))))
    for place, (c, d, s, w) in enumerate(grid):
        (root, priors), *inner = trees[place * len(parts) : (place + 1) * len(parts)]
        master, scores = prune_sequence(root, priors), []
        if selection == "cv":
            steps = [[(a, risk_of(t, q, p, outside, cols)) for a, t in prune_sequence(r, q)] for (r, q), (_, outside) in zip(inner, parts[1:], strict=True)]
            for k, (a, _) in enumerate(master):
                mid = math.sqrt(a * master[k + 1][0]) if k + 1 < len(master) else math.inf
                scores.append(sum(step_value(st, mid) for st in steps) / len(steps))
        else:
            for _, t in master:
                own = [cols[f] for f in tree_features(t)]
                z = compression_set(own, train, p.n) if own else []
                wrong = sum(len(x.rows) - x.counts[priors.predicted(x)] for x in t.leaves())  # the rows of its leaves are those of train
                wrong -= sum(priors.predicted(leaf_of(t, cols, p.n, i)) != p.labels[i] for i in z)
                scores.append(tree_bound(len(train), len(z), wrong, sum(not x.leaf for x in t.walk()), size, classes, delta))
        k = max(range(len(master)), key=lambda k: (-scores[k], k))
        tried.append((scores[k], len(master[k][1].walk()), pvariance(w) if w else 0.0, place, master[k][1], priors, {"criterion": c, "max_depth": d, "min_split": s, "class_importance": w, "score": scores[k]}))
    if progress:
        progress(1.0)
    return least(tried, True, True)[4:]
