"""Quality rules: a learned decision list.

measure() gives every text whole-text statistics. fit() learns an ordered list of threshold conjunctions that reject, by sequential covering: a rule
grows on two thirds of the labelled rows by information gain, is pruned on the last third, and is kept while it is precise on rows it has not grown
on; the rows it covers then leave. case_sql() turns the list into one Spark conditional expression, which is all that judges documents.

The fit reads at most SAMPLE labelled rows (those with the least hash of their doc_id); statistics cover all rows. Texts are measured whole, some 100
bytes of memory a word. Null text is empty: it has no words and fails the base rule. Null labels and labels of unknown documents teach nothing; without labels of both classes the list is empty and keeps all
that the base rule keeps. Repeated rows are judged alike; an empty table gives an empty one; other columns pass through with_stats() unharmed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, unused
from .wordhash import CHUNK, Chunk, numbered

NAME = "op6_decision_list"
#: Labelled rows that a fit reads at most, thresholds tried for each statistic, rules at most.
SAMPLE, STEPS, RULES = 20_000, 48, 16
#: Least share of rejected rows among those that a rule covers, and least number of them.
PRECISION, COVER = 0.9, 8
#: The base rule's symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_bangs")
BASE = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
#: The statistics that rules speak of, in SQL over the counts.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digits_per_word": "n_digits / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


#: Bytes that a text's counts leave out: what remains is counted. Words keep one byte of each code point.
UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in (b"AZ", b"az", b"09"))
KINDS = {"word_chars": b" \t\n\v\f\r" + bytes(range(0x80, 0xC0)), "n_symbols": SYMBOLS, "n_upper": UPPER, "n_letters": UPPER + LOWER, "n_digits": DIGITS, "n_bangs": b"!"}


def counted(texts: list[bytes]) -> dict[str, list[int]]:
    """Bytes of each kind, by deleting them (word_chars: all others)."""
    left = {k: [len(t.translate(None, x)) for t in texts] for k, x in KINDS.items()}
    return {k: n if k == "word_chars" else [len(t) - m for t, m in zip(texts, n, strict=True)] for k, n in left.items()}


def measure(raw: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS for each text; words and windows are told apart exactly, by their codes."""
    parts, i = [], 0
    while i < len(raw) or not parts:
        j, held = i, 0
        while j < len(raw) and (j == i or held + len(raw[j]) <= CHUNK):
            held += len(raw[j])
            j += 1
        parts.append(measured(raw[i:j]))
        i = j
    return {k: np.concatenate([p[k] for p in parts]) for k in COUNTS}


def measured(raw: list[bytes]) -> dict[str, np.ndarray]:
    c = Chunk([0] * len(raw), raw)
    out = {k: np.array(v, dtype=np.int64) for k, v in counted(raw).items()} | {"n_words": c.hi - c.lo}
    out["n_distinct_words"] = np.bincount(np.unique(c.doc << 32 | c.code) >> 32, minlength=len(raw))
    start = np.flatnonzero(c.inside(3)) if len(c.doc) else np.empty(0, np.int64)
    pair = numbered(c.code[:-1] << 32 | c.code[1:])
    window = numbered(pair[start] << 32 | c.code[start + 2]) if len(start) else start
    _, where, count = np.unique(c.doc[start] << 32 | window, return_inverse=True, return_counts=True)
    twice = start[count[where] > 1] if len(start) else start
    covered = np.zeros(len(c.doc) + 3, dtype=bool)
    for i in range(3):
        covered[twice + i] = True
    out["n_repeat_words"] = np.bincount(c.doc[covered[: len(c.doc)]], minlength=len(raw))
    spoken = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
    out["n_lines"] = np.array([len(x) for x in spoken], dtype=np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in spoken], dtype=np.int64)
    return {k: out[k] for k in COUNTS}


def with_stats(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a struct of COUNTS, under a name that no column has."""
    prepare(docs.sparkSession)
    name, place = unused("stats", docs.columns), [c.lower() for c in docs.columns].index("text")

    def run(it):
        for batch in it:
            if batch.num_rows:
                raw = [x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()]
                stats = measure(raw)
                new = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in stats.values()], names=list(COUNTS))
                yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])

    kind = docs.select(docs.columns).limit(0).withColumn(name, F.expr("named_struct(" + ", ".join(f"'{c}', 0L" for c in COUNTS) + ")")).schema
    return docs.mapInArrow(run, kind), name


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int, where: str = "true") -> DataFrame:
    """Documents with their label, from at most sample labels; the labels' side is broadcast, which the bound allows. Repeated documents may give more rows."""
    some = labels.where(f"{column} is not null and doc_id is not null and {where}").selectExpr("doc_id", f"cast({column} as int) as label")
    some = some.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    return docs.join(F.broadcast(some), "doc_id")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.limit!r}D"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return (x[self.feature] > self.limit) == self.above


def grow(x: dict[str, np.ndarray], bad: np.ndarray, limits: dict[str, list[float]]) -> list[Condition]:
    rule, held = [], np.ones(len(bad), dtype=bool)
    while len(rule) < 4 and not bad[held].all():
        p, n = bad[held].sum(), held.sum()
        best, most = None, 1e-9
        for f, values in limits.items():
            for limit in values:
                above = x[f] > limit
                for side in (True, False):
                    now = held & (above == side)
                    q, m = bad[now].sum(), now.sum()
                    if q and (gain := q * (np.log2(q / m) - np.log2(p / n))) > most:
                        best, most = (Condition(f, side, limit), now), gain
        if best is None:
            break
        rule.append(best[0])
        held = best[1]
    return rule


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The prefix of the rule that tells best on rows it has not grown on."""
    def worth(k: int) -> float:
        c = covers(rule[:k], x, len(bad))
        return (bad[c].sum() - (~bad[c]).sum()) / max(c.sum(), 1)

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def thresholds(v: np.ndarray) -> list[float]:
    """Midpoints between neighbouring values: at STEPS quantiles of the distinct values, and in the widest gaps."""
    own = np.unique(v)
    if len(own) < 2:
        return []
    at = {int(i) for i in np.linspace(0, len(own) - 2, STEPS)} | {int(i) for i in np.argsort(np.diff(own))[-STEPS // 3 :]}
    return sorted({float((own[i] + own[i + 1]) / 2) for i in at})


def learn(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[list[Condition]]:
    """Sequential covering; order deals the rows to growing and pruning."""
    limits = {f: thresholds(v) for f, v in x.items()}
    fold, left, out = order % 3 == 2, np.ones(len(bad), dtype=bool), []
    while len(out) < RULES and bad[left].sum() >= COVER and not bad[left].all():
        g, p = left & ~fold, left & fold
        rule = grow({f: v[g] for f, v in x.items()}, bad[g], limits)
        if not rule:
            break
        if p.any():
            rule = prune(rule, {f: v[p] for f, v in x.items()}, bad[p])
        hit = covers(rule, x, len(bad)) & left
        new = hit & fold
        if hit.sum() < COVER or bad[hit].mean() < PRECISION or (new.any() and bad[new].mean() < PRECISION):
            break
        out.append(rule)
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    some, name = with_stats(labelled(docs.selectExpr("doc_id", "text"), labels, "quality", sample))
    rows = some.select("doc_id", "label", f"{name}.*").selectExpr("doc_id", "label", *(f"{sql} as {f}" for f, sql in FEATURES.items())).distinct()
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", *FEATURES).limit(sample).toArrow()  # a doc_id of many texts gives no more than sample rows
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "label", *FEATURES)])
    x = {f: rows.column(f).to_numpy().astype(float) for f in FEATURES}
    bad = rows.column("label").to_numpy() == 0
    return learn(x, bad, np.arange(len(bad)))


def case_sql(rules: list[list[Condition]]) -> str:
    """True: the list keeps the document."""
    return "case " + " ".join(f"when {' and '.join(c.sql() for c in r)} then false" for r in rules) + " else true end" if rules else "true"


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """docs, COUNTS, base_failed, kept, as columns of a struct named verdict (or verdict_, ...) behind docs' own."""
    df, name = with_stats(docs)
    flat = unused("verdict", docs.columns)
    within = lambda sql: F.expr(re.sub(r"\b(" + "|".join(COUNTS) + r")\b", rf"`{name}`.\1", sql))
    parts = [F.col(f"`{name}`.{c}").alias(c) for c in COUNTS]
    base = within(BASE)
    return df.withColumn(flat, F.struct(*parts, base.alias("base_failed"), (~base & within(case_sql(rules))).alias("kept"))).drop(name)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    judged = judge(docs, fit(docs, labels))
    return judged.where(F.col(f"`{judged.columns[-1]}`.kept")).select(*(f"`{c}`" for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels)).selectExpr("doc_id", "verdict.*")
