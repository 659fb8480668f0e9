"""Set covering machines: greedy conjunctions and disjunctions of presence and absence rules."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.bits import counted, masked_count
from .matrix import Problem

log = logging.getLogger(__name__)
RTOL, ATOL = 1e-5, 1e-8
P_GRID = (0.1, 0.316, 0.562, 1.0, 1.778, 3.162, 10.0, 999999.0)


@dataclass(frozen=True)
class Rule:
    feature: str
    kind: str  # presence or absence

    def inverse(self) -> Rule:
        return Rule(self.feature, "absence" if self.kind == "presence" else "presence")

    def __str__(self) -> str:
        return f"{self.kind.title()}({self.feature})"


@dataclass
class Model:
    """A conjunction or disjunction; the empty conjunction says 1, the empty disjunction 0."""

    type: str
    rules: list[Rule] = field(default_factory=list)
    equivalent: list[list[Rule]] = field(default_factory=list)
    importances: list[float] = field(default_factory=list)

    def __str__(self) -> str:
        return (" and " if self.type == "conjunction" else " or ").join(map(str, self.rules))

    def __len__(self) -> int:
        return len(self.rules)

    def __bool__(self) -> bool:
        return True  # without rules too

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def add(self, rule: Rule) -> None:
        self.rules.append(rule)

    def remove(self, index: int) -> None:
        for own in (self.rules, self.equivalent, self.importances):
            if index < len(own):
                del own[index]

    def features(self) -> list[str]:
        return [r.feature for r in self.rules]

    def predict(self, rows: dict[str, int], n: int) -> list[int]:
        """Classes of n examples, from the features' presence as whole numbers (bit n - 1 - gi)."""
        every = (1 << n) - 1
        out = every if self.type == "conjunction" else 0
        for r in self.rules:
            x = rows.get(r.feature, 0)
            x = x if r.kind == "presence" else every & ~x
            out = out & x if self.type == "conjunction" else out | x
        return [out >> (n - 1 - i) & 1 for i in range(n)]

    def predict_proba(self, rows: dict[str, int], n: int) -> list[tuple[float, float]]:
        """Of classes 0 and 1: rules say one or the other, and so do models."""
        return [(1.0 - x, float(x)) for x in self.predict(rows, n)]

    def expression(self, have: Column | str = "have") -> Column:
        """The class as a column over an array of the features that a row has."""
        said = [F.array_contains(have, F.lit(r.feature)) == F.lit(r.kind == "presence") for r in self.rules]
        out = F.lit(self.type == "conjunction")
        for x in said:
            out = out & x if self.type == "conjunction" else out | x
        return out.cast("int")

    def probabilities(self, have: Column | str = "have") -> Column:
        x = self.expression(have).cast("double")
        return F.array(F.lit(1.0) - x, x)


def guarded(model: Model | None) -> Model:
    """A model that has been learnt; predicting before that is an error."""
    if model is None:
        raise RuntimeError("the model has not been learnt yet")
    return model


class SetCoveringMachine:
    """A learner of fixed settings, as an object; fit() is the function behind it."""

    def __init__(self, type: str = "conjunction", p: float = 1.0, max_rules: int = 10):
        self.type, self.p, self.max_rules, self.model = type, p, max_rules, None

    def fit(self, problem: Problem, train: list[int] | None = None, **options) -> SetCoveringMachine:
        self.model = fit(problem, self.type, self.p, self.max_rules, train, **options)
        return self

    @property
    def rules(self) -> list[Rule]:
        return guarded(self.model).rules

    @property
    def rule_importances(self) -> list[float]:
        return guarded(self.model).importances

    def predict(self, problem: Problem) -> list[int]:
        model = guarded(self.model)
        return model.predict(columns(problem, model.features()), problem.n)

    def predict_proba(self, problem: Problem) -> list[tuple[float, float]]:
        model = guarded(self.model)
        return model.predict_proba(columns(problem, model.features()), problem.n)


def columns(p: Problem, names: list[str]) -> dict[str, int]:
    """The presence of a few features, as whole numbers: the only columns that leave the executors."""
    out = {}
    for r in p.features.where(F.col("feature").isin(sorted(set(names)))).collect() if names else []:
        out[r.feature] = whole(r.words, p.n)
    return out


def whole(words: list, n: int) -> int:
    """A feature's presence as one whole number."""
    own = bytearray(8 * -(-n // 64))
    for w in words:
        own[8 * w.at : 8 * w.at + 8] = w.bits.to_bytes(8, "big", signed=True)
    return int.from_bytes(own, "big") >> -n % 64


def spelled(x: int, n: int) -> np.ndarray:
    """A feature's presence by example, from its whole number."""
    return np.unpackbits(np.frombuffer((x << -n % 8).to_bytes(-(-n // 8), "big"), np.uint8), count=n)


def scored(p: Problem, pos: list[int], neg: list[int], cost: float, train_pos: list[int], train_neg: list[int], source: DataFrame | None = None) -> DataFrame:
    """feature, words, kind, neg_cover, pos_err, utility, risk of each rule; risk is that over the whole training set."""
    count = lambda rows: masked_count(F.col("words"), p.mask(rows))
    n_pos, n_neg, t_pos, t_neg = len(pos), len(neg), len(train_pos), len(train_neg)
    df = (p.patterns if source is None else source).select("feature", "words", count(pos).alias("hp"), count(neg).alias("hn"), count(train_pos).alias("tp"), count(train_neg).alias("tn"))
    df = df.selectExpr("feature", "words", "hp", "hn", f"bround(({t_pos} - tp + tn) / {t_pos + t_neg}, 5) as r")
    df = df.selectExpr("feature", "words", f"stack(2, 'presence', {n_neg} - hn, {n_pos} - hp, r, 'absence', hn, hp, bround(1 - r, 5)) as (kind, neg_cover, pos_err, risk)")
    return df.withColumn("utility", F.expr(f"neg_cover - {cost!r}D * pos_err"))


def best(rules: DataFrame, conjunction: bool) -> DataFrame:
    """Rules whose utility is as good as the best, without those that change nothing; the chosen one is first by tie_order()."""
    top = rules.agg(F.max("utility").alias("top"))
    close = rules.crossJoin(F.broadcast(top)).where(f"abs(utility - top) <= {ATOL} + {RTOL} * abs(top)").drop("top")  # one row
    return close.where("neg_cover <> 0 or pos_err <> 0")


def tie_order(conjunction: bool) -> list[Column]:
    """Least risk for a conjunction, most for a disjunction; presence before absence; by name."""
    return [F.asc("risk") if conjunction else F.desc("risk"), F.desc("kind"), F.asc("feature")]


def first(close: DataFrame, conjunction: bool) -> Row | None:
    """The rule that comes first by tie_order(), with its words: a minimum of structs, combined in every task."""
    place = F.struct(F.col("risk") if conjunction else -F.col("risk"), F.when(F.col("kind") == "presence", 0).otherwise(1), "feature")
    return (close.agg(F.min_by(F.struct("feature", "kind", "words", "risk", "utility", "neg_cover", "pos_err"), place).alias("x")).first() or [None])[0]


def fit(p: Problem, type: str, cost: float, max_rules: int = 10, train: list[int] | None = None, blacklist: DataFrame | None = None, on_iteration=None, most: int = 0, seed: int = 0, tiebreaker=None) -> Model:
    """Greedy covering. The driver holds which examples are left; each step is one job over the persisted patterns: the best utility, and the first rule that is as good.

    With most, a second job a step finds the rules that are as good as the chosen one; of more than most, seed draws. tiebreaker(rules, conjunction), if
    given, chooses from the table of equally good rules (a row with feature, kind, words and risk, or None); on_iteration(model, row) is told of each rule.
    """
    rows = range(p.n) if train is None else train
    conjunction = type == "conjunction"
    pos, neg = [i for i in rows if p.labels[i] == 1], [i for i in rows if p.labels[i] == 0]
    if not pos or not neg:
        raise ValueError("both classes are needed to learn")
    t_pos, t_neg = list(pos), list(neg)
    if not conjunction:
        pos, neg = neg, pos
    every, source = p.without(blacklist)
    model, start, outputs = Model(type), sorted(pos + neg), []
    while neg and len(model) < max_rules:
        found = (tiebreaker or first)(best(scored(p, pos, neg, cost, t_pos, t_neg, source), conjunction), conjunction)
        if not found:
            break
        rule = Rule(found.feature, found.kind)
        if most:
            ties = best(scored(p, pos, neg, cost, t_pos, t_neg, every), conjunction).where(F.col("risk") == found.risk)
            drawn = [Rule(r.feature, r.kind) for r in ties.select("feature", "kind").orderBy(F.xxhash64("feature", "kind", F.lit(seed)), "feature", "kind").limit(most).collect()]
            model.equivalent.append(sorted((r if conjunction else r.inverse() for r in drawn), key=lambda r: (r.feature, r.kind)))
        x = whole(found.words, p.n)
        ok = lambda i, x=x, r=rule: bool(x >> (p.n - 1 - i) & 1) == (r.kind == "presence")
        pos, neg = [i for i in pos if ok(i)], [i for i in neg if ok(i)]
        outputs.append({i: ok(i) for i in start})
        model.add(rule if conjunction else rule.inverse())
        if on_iteration:
            on_iteration(model, found)
    zero = [i for i in start if any(not o[i] for o in outputs)]
    model.importances = [sum(not o[i] for i in zero) / len(zero) if zero else 0.0 for o in outputs]
    return model


STATES = "pos array<bigint>, neg array<bigint>, train_pos array<bigint>, train_neg array<bigint>, n_pos long, n_neg long, t_pos long, t_neg long, jobs array<struct<job: int, cost: double, conjunction: boolean>>"


def fit_all(p: Problem, jobs: list[tuple[str, float, list[int]]], max_rules: int = 10, blacklist: DataFrame | None = None, progress=None) -> tuple[list[Model], dict[str, int]]:
    """The models that fit() gives for each type, cost and training rows, and the columns of their features. All searches take each step in common scans.

    Searches whose examples left are the same share their counts; masks are data, so no step compiles code of its own. progress(share) is told how far it is.
    """
    source = p.without(blacklist)[1]
    if blacklist is not None:
        source = source.persist()
    models, left, outputs, cols = [Model(t) for t, _, _ in jobs], [], [[] for _ in jobs], {}
    for t, _, rows in jobs:
        sides = [i for i in rows if p.labels[i] == 1], [i for i in rows if p.labels[i] == 0]
        if not all(sides):
            raise ValueError("both classes are needed to learn")
        left.append(sides if t == "conjunction" else sides[::-1])
    start, open_ = [a + b for a, b in left], list(range(len(jobs)))
    for step in range(max_rules):
        if progress:
            progress(step / max_rules)
        open_ = [j for j in open_ if left[j][1]]
        if not open_:
            break
        states: dict[tuple, list] = {}
        for j in open_:
            t, cost, rows = jobs[j]
            states.setdefault((*map(tuple, left[j]), tuple(rows)), []).append((j, float(cost), t == "conjunction"))
        lines = []
        for (pos, neg, rows), own in states.items():
            every = [i for i in rows if p.labels[i] == 1], [i for i in rows if p.labels[i] == 0]
            lines.append((*(p.mask(x) for x in (pos, neg, *every)), *map(len, (pos, neg, *every)), own))
        count = lambda m: counted("words", F.col(m))
        df = source.select("feature", "words").crossJoin(F.broadcast(p.features.sparkSession.createDataFrame(lines, STATES)))  # a row a state
        df = df.select("feature", "jobs", "n_pos", "n_neg", "t_pos", "t_neg", count("pos").alias("hp"), count("neg").alias("hn"), count("train_pos").alias("tp"), count("train_neg").alias("tn"))
        df = df.selectExpr("feature", "jobs", "n_pos", "n_neg", "hp", "hn", "bround((t_pos - tp + tn) / (t_pos + t_neg), 5) as r")
        df = df.selectExpr("feature", "jobs", "stack(2, 'presence', n_neg - hn, n_pos - hp, r, 'absence', hn, hp, bround(1 - r, 5)) as (kind, neg_cover, pos_err, risk)")
        df = df.selectExpr("*", "explode(jobs) as x").selectExpr("x.job", "x.conjunction", "feature", "kind", "neg_cover", "pos_err", "risk", "neg_cover - x.cost * pos_err as utility")
        close = df.join(F.broadcast(df.groupBy("job").agg(F.max("utility").alias("top"))), "job").where(f"abs(utility - top) <= {ATOL} + {RTOL} * abs(top) and (neg_cover <> 0 or pos_err <> 0)")  # a row a search
        chosen = close.groupBy("job").agg(F.expr("min(struct(if(conjunction, risk, -risk) as risk, if(kind = 'presence', 0, 1) as place, feature, kind)) as x"))
        found = {r.job: Rule(r.feature, r.kind) for r in chosen.select("job", "x.feature", "x.kind").collect()}
        cols |= columns(p, [r.feature for r in found.values() if r.feature not in cols])
        for j, rule in found.items():
            ok = {i: bool(cols.get(rule.feature, 0) >> (p.n - 1 - i) & 1) == (rule.kind == "presence") for i in start[j]}
            left[j] = [i for i in left[j][0] if ok[i]], [i for i in left[j][1] if ok[i]]
            outputs[j].append(ok)
            models[j].rules.append(rule if models[j].type == "conjunction" else rule.inverse())
        open_ = list(found)
    for model, rows, own in zip(models, start, outputs, strict=True):
        zero = [i for i in rows if any(not o[i] for o in own)]
        model.importances = [sum(not o[i] for i in zero) / len(zero) if zero else 0.0 for o in own]
    if blacklist is not None:
        source.unpersist()
    return models, cols


def compression_set(cols: list[int], rows: list[int], n: int) -> list[int]:
    """Greedy cover of the model's features by examples that have them; features that no example has can't be covered."""
    at = np.asarray(rows, int)
    left = [c for c in cols if spelled(c, n)[at].any()]
    if len(left) < len(cols):
        log.warning("%d model features are in no training example", len(cols) - len(left))
    have = np.zeros(len(at), int)  # how many of the features left each example has
    for c in left:
        have += spelled(c, n)[at]
    out = []
    while left:
        i = rows[int(have.argmax())]
        out.append(i)
        for c in left:
            if c >> (n - 1 - i) & 1:
                have -= spelled(c, n)[at]
        left = [c for c in left if not c >> (n - 1 - i) & 1]
    return out


def bound(m: int, z: int, r: int, h: int, genome_size: int, delta: float = 0.05, compat: bool = True) -> float:
    """Sample-compression bound: m examples, z in the compression set, r errors outside it, h rules.

    compat drops the terms that the established form drops: the last one for h = 0, the two binomials for h > 0.
    """
    ln_c = lambda n, k: math.log(math.comb(n, k))
    sets = ln_c(m, z) + ln_c(m - z, r)
    tail = math.log(math.pi**6 * (h + 1) ** 2 * (r + 1) ** 2 * (z + 1) ** 2 / (216 * delta))
    rules = h * math.log(2 * z * genome_size) if h and z else 0.0
    b = (sets if h == 0 else rules + tail) if compat else sets + rules + tail
    return 1 - math.exp(-b / (m - z - r)) if m - z - r > 0 else 1.0


def errors(model: Model, cols: dict[str, int], p: Problem, rows: list[int]) -> list[int]:
    pred = model.predict(cols, p.n)
    return [i for i in rows if pred[i] != p.labels[i]]


def model_bound(p: Problem, model: Model, train: list[int], genome_size: int, delta: float = 0.05, compat: bool = True, cols: dict[str, int] | None = None) -> float:
    cols = columns(p, [r.feature for r in model.rules]) if cols is None else cols
    z = compression_set([cols.get(r.feature, 0) for r in model.rules], train, p.n) if model.rules else []
    wrong = set(errors(model, cols, p, train)) - set(z)
    return bound(len(train), len(z), len(wrong), len(model.rules), genome_size, delta, compat)


def prefix_risks(p: Problem, model: Model, test: list[int], max_rules: int, cols: dict[str, int] | None = None) -> list[float]:
    """Risk on test of each prefix of the model, the last repeated up to max_rules."""
    cols = columns(p, [r.feature for r in model.rules]) if cols is None else cols
    out = [len(errors(Model(model.type, model.rules[:k]), cols, p, test)) / max(len(test), 1) for k in range(len(model.rules) + 1)]
    return out + [out[-1]] * (max_rules + 1 - len(out))


def best_length(risks: DataFrame) -> DataFrame:
    """length, score: of the risks (length, risk) of all folds, the least mean, and of equal ones the least length."""
    return risks.groupBy("length").agg(F.avg("risk").alias("score")).orderBy("score", "length").limit(1)


def close_to(a: float, b: float) -> bool:
    """Equal within the tolerance of utilities; infinities are equal to themselves."""
    return a == b or abs(a - b) <= ATOL + RTOL * abs(b)


def least(tried: list[tuple], close: bool, lower_wins: bool = False) -> tuple:
    """The first of the tuples in order, their first being scores. With close, scores close to the best so far are ties; with lower_wins not if they are lower."""
    best = tried[0]
    for x in tried[1:]:
        tie = x[0] == best[0] or close and close_to(x[0], best[0])
        if x[0] < best[0] and (lower_wins or not tie) or tie and x[1:4] < best[1:4]:
            best = x
    return best


def learn_scm(p: Problem, train: list[int], folds: list[int] | None = None, types=("conjunction", "disjunction"), costs=P_GRID, max_rules: int = 10, selection: str = "cv", delta: float = 0.05, genome_size: int | None = None, blacklist: DataFrame | None = None, most: int = 0, seed: int = 0, progress=None) -> tuple[Model, dict]:
    """The best model over the grid, trained on all of train. folds[k] is the fold of train[k]. Ties: score, fewer rules, p nearer to 1, place in the grid."""
    size = genome_size or p.features.count()
    if selection not in ("cv", "bound"):
        t, c = sorted(types)[0], min(costs)
        return fit(p, t, c, max_rules, train, blacklist, None, most, seed), {"type": t, "p": c, "max_rules": max_rules}
    grid, tried = [(t, c) for t in types for c in costs], []
    parts = [(train, [])] if selection == "bound" else [([i for i, g in zip(train, folds, strict=True) if g != f], [i for i, g in zip(train, folds, strict=True) if g == f]) for f in sorted(set(folds))]
    models, cols = fit_all(p, [(t, c, inside) for t, c in grid for inside, _ in parts], max_rules, blacklist, progress)
    for place, (t, c) in enumerate(grid):
        own = models[place * len(parts) : (place + 1) * len(parts)]
        if selection == "cv":
            by_fold = [prefix_risks(p, m, outside, max_rules, cols) for m, (_, outside) in zip(own, parts, strict=True)]
            mean = [round(sum(x) / len(x), 12) for x in zip(*by_fold, strict=True)]
            score = min(mean)
            tried.append((score, mean.index(score), abs(1 - c), place, t, c, None))
        else:
            options = [Model(t, own[0].rules[:k], importances=own[0].importances[:k]) for k in range(len(own[0].rules) + 1)]
            bounds = [model_bound(p, o, train, size, delta, cols=cols) for o in options]
            score = min(bounds)
            k = bounds.index(score)
            tried.append((score, k, abs(1 - c), place, t, c, options[k]))
    score, k, _, _, t, c, model = least(tried, selection == "cv")
    if model is None or most:
        model = fit(p, t, c, k, train, blacklist, None, most, seed)
    if progress:
        progress(1.0)
    return model, {"type": t, "p": c, "max_rules": k, "score": score}
