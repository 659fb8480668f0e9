"""Quality classifier: a factorisation machine.

A text becomes a sparse row: its words hashed to WORDS places, weighted by log counts and scaled to length 1, then structure statistics and the
metadata (recorded and measured length), standardised. The score is the logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the
pairwise part is half of the sum over factors of (sum v_i x_i)^2 - sum v_i^2 x_i^2, linear in the words of the text.

The fit runs on the driver over at most SAMPLE labelled rows, which come hashed; label, language, source and id are no inputs. Null text is empty and is scored by its
statistics; a null or missing n_chars counts as 0. Rows with a null doc_id are scored, and never learnt from. Without labels of both classes every
score is the share of label 1 (0.5 if none). Repeated rows score alike; an empty table gives an empty one. Texts are hashed whole, some 100 bytes of
memory a word. Columns other than doc_id, text and n_chars are not read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts
from .op6_decisions import labelled, measure
from .wordhash import Chunk, U

NAME = "op7_factorisation_machine"
#: Places for words (a power of two), factors, labelled rows that a fit reads at most, passes over them.
WORDS, FACTORS, SAMPLE, PASSES = 1 << 14, 8, 4_000, 12
RATE, DECAY, BATCH, SEED = 0.1, 1e-4, 200, 7
THRESHOLD = 0.7
STATS = ("log_words", "mean_word_length", "symbols_per_word", "bangs_per_word", "upper_share", "digits_per_word", "repeated_share", "distinct_share", "duplicate_line_share", "log_words_per_line", "log_chars", "chars_off")


def numbers(raw: list[bytes], n_chars: np.ndarray) -> np.ndarray:
    """A row of STATS for each text."""
    m = {k: v.astype(float) for k, v in measure(raw).items()}
    n, lines_ = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    size = np.array([len(x) for x in raw], dtype=float)
    cols = (np.log1p(m["n_words"]), m["word_chars"] / n, m["n_symbols"] / n, m["n_bangs"] / n, m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_digits"] / n, m["n_repeat_words"] / n, m["n_distinct_words"] / n, m["n_dup_lines"] / lines_, np.log1p(m["n_words"] / lines_), np.log1p(np.maximum(n_chars, 0)), np.log1p(np.maximum(n_chars, 0)) - np.log1p(size))
    return np.stack(cols, axis=1)


def hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of the words, in order of row and place."""
    c = Chunk([0] * len(raw), raw, lower=True, numbers=False)
    key, count = np.unique(c.doc.astype(U) * U(WORDS) + (c.hash & U(WORDS - 1)), return_counts=True)
    row, place, x = (key // U(WORDS)).astype(np.int64), (key % U(WORDS)).astype(np.int64), np.log1p(count)
    norm = np.sqrt(np.bincount(row, x * x, minlength=len(raw)))
    return row, place, x / np.maximum(norm[row], 1e-12)


@dataclass
class Machine:
    bias: float
    w: np.ndarray  # of words, then of STATS
    v: np.ndarray  # FACTORS each
    mean: np.ndarray
    scale: np.ndarray

    def raw_scores(self, row: np.ndarray, place: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums before the logistic, and the sum over v x of each row."""
        n = len(stats)
        vx = self.v[place] * x[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], minlength=n) for f in range(self.v.shape[1])], axis=1) if n else np.zeros((0, self.v.shape[1]))
        squares = np.bincount(row, (vx * vx).sum(axis=1), minlength=n)
        w, v = self.w[WORDS:], self.v[WORDS:]
        sums += stats @ v
        squares += (stats**2) @ (v**2).sum(axis=1)
        line = self.bias + np.bincount(row, self.w[place] * x, minlength=n) + stats @ w
        return line + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def score(self, raw: list[bytes], n_chars: np.ndarray) -> np.ndarray:
        z = self.raw_scores(*hashed(raw), self.standard(numbers(raw, n_chars)))[0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(row: np.ndarray, place: np.ndarray, x: np.ndarray, stats: np.ndarray, y: np.ndarray) -> Machine:
    """Stochastic gradients with per-weight rates, on log loss. Words come as hashed() has them, statistics as numbers()."""
    rng = np.random.default_rng(SEED)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    mean, scale = (stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)) if len(y) else (np.zeros(len(STATS)), np.ones(len(STATS)))
    size = WORDS + len(STATS)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)), mean, scale)
    if len(set(y.tolist())) < 2:
        return m
    m.v = rng.normal(0, 0.02, (size, FACTORS))
    at, z = np.searchsorted(row, np.arange(len(y) + 1)), m.standard(stats)
    seen_w, seen_v = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    tail = np.arange(WORDS, size)
    for _ in range(PASSES):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            pick = order[k : k + BATCH]
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in pick])
            r = np.repeat(np.arange(len(pick)), at[pick + 1] - at[pick])
            p, v = place[take], x[take]
            out, sums = m.raw_scores(r, p, v, z[pick])
            g = (1 / (1 + np.exp(-np.clip(out, -60, 60))) - y[pick]) / len(pick)
            m.bias -= RATE * float(g.sum())
            gw = np.bincount(p, g[r] * v, minlength=size)
            gw[tail] += g @ z[pick]
            gv = np.stack([np.bincount(p, g[r] * (v * sums[r, f] - m.v[p, f] * v * v), minlength=size) for f in range(FACTORS)], axis=1)
            gv[tail] += (z[pick] * g[:, None]).T @ sums - m.v[tail] * (g @ z[pick] ** 2)[:, None]
            gw += DECAY * m.w
            gv += DECAY * m.v
            seen_w += gw**2
            seen_v += gv**2
            m.w -= RATE * gw / np.sqrt(seen_w)
            m.v -= RATE * 0.3 * gv / np.sqrt(seen_v)
    return m


def inputs(docs: DataFrame) -> DataFrame:
    size = "coalesce(cast(n_chars as bigint), 0L)" if "n_chars" in docs.columns else "0L"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", f"{size} n_chars")


HELD = "crc32(cast(doc_id as string)) % 4 = 2"


def described(it):
    """doc_id, label and the sparse row of each document."""
    for batch in it:
        if batch.num_rows:
            raw = texts(batch)
            row, place, x = hashed(raw)
            at = pa.array(np.searchsorted(row, np.arange(len(raw) + 1)).astype(np.int32))
            stats = numbers(raw, batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float))
            lists = [pa.ListArray.from_arrays(at, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(x)), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(STATS)).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "place", "x", "stats"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from rows that are not held out. Texts are hashed where they are; the driver gets at most WORDS numbers for each of the sample rows."""
    prepare(docs.sparkSession)
    rows = labelled(inputs(docs), labels, "quality", sample, where=f"not ({HELD})").mapInArrow(described, "doc_id long, label int, place array<int>, x array<double>, stats array<double>")
    key = ["doc_id", "label", "place", "x", "stats"]
    own = rows.orderBy(F.xxhash64("doc_id"), *key).limit(sample).orderBy(*key).toArrow()  # a doc_id of many texts gives no more than sample rows
    flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in own.column(c).chunks] or [np.empty(0)])
    size = own.column("place").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if own.num_rows else np.empty(0, np.int64)
    y = (own.column("label").to_numpy() == 1).astype(float)
    return train(np.repeat(np.arange(len(y)), size), flat("place").astype(np.int64), flat("x"), flat("stats").reshape(-1, len(STATS)), y)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)

    def run(it):
        for batch in it:
            if batch.num_rows:
                s = machine.score(texts(batch), batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], schema=SCHEMA)

    out = inputs(docs).mapInArrow(run, "doc_id long, score double")
    return out.selectExpr("doc_id", f"coalesce({HELD}, false) as held_out", "score", f"if(score >= {THRESHOLD}D, 1, 0) as predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
