"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles, hashed to 64 bits, in one order for all documents: rare tokens first, then frequent ones, each by
hash. For a set of n tokens and a threshold of pct per cent, let o = ceil(pct n / 100), D = floor(n (100 - pct) / pct), and k = 1 to 3.

- Two linked sets share k tokens in their prefixes of n - o + k tokens. If these are rare, k single tokens meet in the index.
- Else fewer than k rare tokens are shared, and prefixes extended to n - o + D + 1 + k tokens share D + 2 frequent ones. At most D tokens of
  either set stand between those, so two of them are neighbours in both sets: frequent tokens are indexed by pairs of neighbours.

So the frequent tokens of a passage that many documents share index nothing unless such tokens fill the prefix. Any choice of the frequent class
gives right results; it holds the FREQUENT most counted tokens, so what is broadcast is bounded. Keys of up to SMALL sets emit their pairs, counted
before any text is fetched. For larger keys, all sets are first checked against the key's least document, and only pairs that are still in
different components are looked at further: copies by the thousand cost a star, not all pairs.

Tokens are 64-bit hashes, which nominate pairs; whether two sets link is decided by their words. Sets whose 128-bit digests of tokens are equal are one
from the start. A set of fewer words than a shingle never equals a longer one. A task holds the sets of two whole texts.

Null and empty texts have no tokens and link with nothing; a null doc_id links with nothing and gets a null
component. Rows with one doc_id are one document with several texts: their links unite. An empty table gives an empty one; other columns stay unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, prepare, table, texts
from .components import components
from .wordhash import Chunk, U, chunks, hashed, mix, windows

NAME = "op9_token_combination_join"
#: Tokens of the frequent class (512 KB to broadcast), the count from which a token is frequent, and its count in a chunk that is passed on always.
FREQUENT, COUNTED, LOCAL = 65_536, 48, 4
#: Sets up to which a key emits its pairs.
SMALL = 48
#: Sets of a larger key that are compared with each other in one block, where all links are counted.
BLOCK = 256
#: Sets of a key in one block where different components are compared; two blocks meet in one task, so no key's square does.
CELL = 1024
#: What a shared pair of neighbours counts for, beside 1 for a single token.
WHOLE = 3


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The set, sorted."""
    if not len(h):
        return h
    n = min(len(h), size)
    out = windows(h, n)
    if n < size:
        out = mix(out + U(n))
    out.sort()
    first = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]


def sets(c: Chunk, size: int) -> list[np.ndarray]:
    return [shingles(c.hash[a:b], size) for a, b in zip(c.lo, c.hi, strict=True)]


def bounds(n: int, pct: int) -> tuple[int, int, int]:
    """Least overlap, most tokens that are not shared, and the shared tokens asked for."""
    o, d = -(-pct * n // 100), n * (100 - pct) // pct
    return o, d, max(1, min(3, o - d - 1))


def counted(it: Iterator[pa.RecordBatch], size: int, pct: int) -> Iterator[pa.RecordBatch]:
    """Tokens with their count in a chunk: those of the prefixes by hash, and any that is frequent in the chunk."""
    for c in chunks(it, lower=True, numbers=False):
        own = list({s.tobytes(): s for s in sets(c, size) if len(s)}.values())
        if own:
            token, n = np.unique(np.concatenate(own), return_counts=True)
            first = np.unique(np.concatenate([s[: len(s) - bounds(len(s), pct)[0] + 8 + len(s) // 4] for s in own]))
            keep = n >= LOCAL
            keep[np.searchsorted(token, first)] = True
            yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(n[keep])], names=["token", "n"])


def keys(s: np.ndarray, frequent: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Index keys of a set, what each counts for, the number of its rare tokens, and that of those without a key."""
    n = len(s)
    o, d, k = bounds(n, pct)
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(n, dtype=bool)
    rare, common = s[~often], s[often]
    single = rare[: n - o + k]
    pairs = common[: max(0, n - o + d + 1 + k - len(rare))]
    pairs = mix(pairs[:-1] * U(0x9E3779B97F4A7C15) + pairs[1:])
    return np.concatenate([single, pairs]), np.repeat([1, WHOLE], [len(single), len(pairs)]), len(rare), len(rare) - len(single)


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("r", pa.int64()), ("unseen", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.struct([("key", pa.int64()), ("w", pa.int8())])))])


def described(it: Iterator[pa.RecordBatch], size: int, pct: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    for c in chunks(it, lower=True, numbers=False):
        own = sets(c, size)
        found = [keys(s, frequent, pct) if len(s) and ok else (s[:0], np.empty(0, int), 0, 0) for s, ok in zip(own, c.known, strict=True)]
        key = np.concatenate([f[0] for f in found]).view(np.int64)
        weight = np.concatenate([f[1] for f in found]).astype(np.int8)
        at = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
        nested = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(key), pa.array(weight)], names=["key", "w"]))
        sig = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) and ok else None for s, ok in zip(own, c.known, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.ids, mask=~c.known), pa.array([len(s) for s in own], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array(sig, pa.binary()), nested.cast(SETS.field("keys").type)], schema=SETS)


def exact(raw: bytes, size: int, known: dict[bytes, int]) -> np.ndarray:
    """The set as distinct runs of word codes, sorted: 4 bytes a word of each shingle, told apart by words and not by hashes."""
    words = raw.lower().split()
    n = min(len(words), size)
    if not n:
        return np.empty(0, dtype="V4")
    code = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return np.unique(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, n)).view(f"V{4 * n}").ravel())


def link(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    if a.dtype != b.dtype:  # one has fewer words than a shingle
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= pct * (len(a) + len(b) - both)


def compared(batch: pa.RecordBatch, size: int, pct: int) -> list[bool]:
    """Which pairs of texts link. Rows that follow each other often have the same first text."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__  # a word's number, by first sight in the batch
    last, first, out = None, None, []
    for x, y in zip(texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
        if x != last:
            last, first = x, exact(x, size, known)
        out.append(link(first, exact(y, size, known), pct))
    known.default_factory = None
    return out


def checked(it: Iterator[pa.RecordBatch], size: int, pct: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their texts, those that link."""
    for batch in it:
        keep = pa.array(compared(batch, size, pct), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def linked(it: Iterator[pa.RecordBatch], size: int, pct: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their texts, the digests of those sets that link, as described() has them."""

    @lru_cache(maxsize=2)
    def digest(x: bytes) -> bytes:
        return xxhash.xxh3_128_digest(shingles(hashed(x.lower().split()), size).tobytes())

    for batch in it:
        good = compared(batch, size, pct)
        out = [(digest(x), digest(y)) for x, y, ok in zip(texts(batch, "text_a"), texts(batch, "text_b"), good, strict=True) if ok]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["sig_a", "sig_b"])


def least_count(n: str, pct: int) -> str:
    return f"greatest(1, least({WHOLE}, ceil({pct} * {n} / 100) - floor({n} * {100 - pct} / {pct}) - 1))"


def join(docs: DataFrame, size: int = 5, pct: int = 80, links: bool = False, tables: Tables | None = None) -> DataFrame:
    """doc_id, n_shingles, rep (the least doc_id with an equal set), component_id (the least doc_id reachable by links).

    With links, also n_links: with how many other sets the document's set links, each pair of sets that share a key being verified. Components need
    far fewer pairs: a group of n near copies costs about n, its links n * n / 2.

    Intermediate tables go as they have served; the two or three that the result reads stay in `tables`, for the caller to free.
    """
    spark = prepare(docs.sparkSession)
    tables = tables or Tables(spark)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    top = docs.where("doc_id is not null").mapInArrow(lambda it: counted(it, size, pct), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = top.where(F.col("n") >= COUNTED).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    frequent = np.sort(top.column("token").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(U))
    every = tables.cut(docs.mapInArrow(lambda it: described(it, size, pct, frequent), "doc_id long, n long, r long, unseen long, sig binary, keys array<struct<key: bigint, w: tinyint>>"))
    reps = tables.cut(every.where("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "n", "r", "unseen", "keys")).alias("x")).select("sig", "x.*"))

    posts = reps.select("doc_id", "n", "r", "unseen", F.explode("keys").alias("x")).select("doc_id", "n", "r", "unseen", "x.key", "x.w")
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    posts = tables.cut(posts.join(shared, "key"))
    # m bounds the rare tokens that a set shares with a set that it meets in pairs of frequent ones
    alike = posts.where(f"w < {WHOLE}").groupBy("doc_id").agg(F.count("*").alias("alike"))
    ones = posts.where(f"w < {WHOLE}").withColumn("m", F.lit(0).cast("long"))
    twos = posts.where(f"w = {WHOLE}").join(alike, "doc_id", "left").withColumn("m", F.expr(f"least({WHOLE - 1}, unseen + coalesce(alike, 0))")).select(*ones.columns)
    posts = tables.cut(ones.unionByName(twos).drop("unseen"))
    most = "(least(a.n - a.r, b.n - b.r) + least(a.m, b.m))"
    fits = f"100 * least(a.n, b.n) >= {pct} * greatest(a.n, b.n) and (a.w < {WHOLE} or 100 * {most} >= {pct} * (a.n + b.n - {most}))"
    few, many = posts.where(f"df <= {SMALL}"), posts.where(f"df > {SMALL}")
    pick = ["a.doc_id as a", "b.doc_id as b", f"if(a.w < {WHOLE}, 1, 0) as single", f"if(a.w < {WHOLE}, 0, 1) as pair", "a.n + b.n as n", "least(a.n - a.r, b.n - b.r) as common", f"{least_count('least(a.n, b.n)', pct)} as k"]
    scored = lambda rows: rows.groupBy("a", "b", "n", "common", "k").agg(F.sum("single").alias("single"), F.sum("pair").alias("pair"))
    likely = f"single >= k or (pair > 0 and 100 * (common + single) >= {pct} * (n - common - single))"
    meet = few.alias("a").join(few.alias("b"), F.expr(f"a.key = b.key and a.doc_id < b.doc_id and {fits}")).selectExpr(*pick)
    small = tables.cut(scored(meet))
    hubs = many.groupBy("key").agg(F.min(F.struct("r", "doc_id", "n")).alias("h")).selectExpr("key", "h.doc_id as hub", "h.n as hub_n")
    star = many.join(hubs, "key").where(f"doc_id <> hub and 100 * least(n, hub_n) >= {pct} * greatest(n, hub_n)").selectExpr("least(hub, doc_id) as a", "greatest(hub, doc_id) as b")
    pairs = tables.cut(small.where(likely).select("a", "b").unionByName(star).distinct())

    needed = pairs.selectExpr("explode(array(a, b)) as doc_id").unionByName(many.select("doc_id")).distinct()
    held = tables.cut(docs.join(needed, "doc_id", "left_semi"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.selectExpr("doc_id as b", "text as text_b"), "b").join(held.selectExpr("doc_id as a", "text as text_a"), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: checked(it, size, pct), "a long, b long").distinct()

    found = tables.cut(verify(pairs))
    label = components(found, tables)
    # what the stars left open: sets of a larger key that are still in different components
    named = tables.cut(many.join(label, many.doc_id == label.node, "left").selectExpr("key", "doc_id", "n", "r", "m", "w", "coalesce(component, doc_id) as label"))
    # a key's largest component and its other sets are dealt into blocks; each two blocks are a cell, but for two of the largest component
    most_of = named.groupBy("key", "label").agg(F.count("*").alias("here")).groupBy("key").agg(F.max(F.struct("here", "label")).alias("x"), F.sum("here").alias("n_all"), F.count("*").alias("labels"))
    open_ = most_of.where("labels > 1").selectExpr("key", "x.label as main", f"cast(ceil(x.here / {CELL}) as int) as mains", f"cast(ceil((n_all - x.here) / {CELL}) as int) as others")
    rest = named.join(open_, "key")
    kind = ["doc_id", "n", "r", "m", "w"]
    held_by = rest.where(f"w = {WHOLE}").groupBy(*kind).agg(F.collect_set("key").alias("ks"))
    rest = rest.join(held_by, kind, "left").selectExpr(*kind, "key", "label", "filter(ks, k -> k < key) as before", "others + if(label = main, 0, mains) as cells", "if(label = main, others + pmod(xxhash64(doc_id), mains), pmod(xxhash64(doc_id), others)) as own")
    cells = tables.cut(rest).selectExpr("*", "explode(sequence(0, cells - 1)) as other").selectExpr("*", "least(own, other) as lo", "greatest(own, other) as hi")
    once = f"(a.w < {WHOLE} or not arrays_overlap(a.before, b.before))"  # at the first key that both hold
    cell = "a.key = b.key and a.lo = b.lo and a.hi = b.hi and (a.lo < a.hi or a.doc_id < b.doc_id) and a.label <> b.label"
    # dealt out here: cells are small, and a join that splits uneven parts on both sides would run the square of the pieces as tasks
    side = lambda own: cells.where(f"own = {own}").repartition("key", "lo", "hi")
    meet = side("lo").alias("a").join(side("hi").alias("b"), F.expr(f"{cell} and {fits} and {once}"))
    meet = meet.selectExpr("least(a.doc_id, b.doc_id) as a", "greatest(a.doc_id, b.doc_id) as b", *pick[2:])
    more = scored(scored(meet).unionByName(small))
    more = tables.cut(more.where(likely).select("a", "b").join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        label = components(tables.cut(found.unionByName(verify(more))), tables)
    known = tables.cut(reps.select("sig", F.col("doc_id").alias("rep")).join(label.withColumnRenamed("node", "rep"), "rep", "left"))
    out = every.select("doc_id", "n", "sig").join(known, "sig", "left").selectExpr("doc_id", "sig", "n as n_shingles", "coalesce(rep, doc_id) as rep", "coalesce(component, rep, doc_id) as component_id")
    if not links:
        tables.free(every, known)
        return out.drop("sig")

    # sets that share a larger key meet in blocks of it, at the first key of a kind that both hold; sets that share none are all in small
    blocks = many.join(many.groupBy(*kind).agg(F.collect_set("key").alias("ks")), kind).selectExpr("*", f"cast(ceil(df / {BLOCK}) as int) as blocks")
    blocks = blocks.selectExpr("*", "cast(pmod(xxhash64(doc_id), blocks) as int) as own").selectExpr("*", "explode(sequence(0, blocks - 1)) as other")
    blocks = tables.cut(blocks.selectExpr(*kind, "key", "ks", "own", "least(own, other) as lo", "greatest(own, other) as hi"))
    same = "a.key = b.key and a.w = b.w and a.lo = b.lo and a.hi = b.hi and a.doc_id < b.doc_id and (a.own <> b.own or a.lo = a.hi)"
    meet = blocks.alias("a").join(blocks.alias("b"), F.expr(f"{same} and {fits} and array_min(array_intersect(a.ks, b.ks)) = a.key")).selectExpr("a.doc_id as a", "b.doc_id as b")
    several = reps.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").selectExpr("doc_id as a", "doc_id as b")
    pairs = tables.cut(small.where(likely).select("a", "b").unionByName(meet).unionByName(several).distinct())
    held = tables.cut(docs.join(pairs.selectExpr("explode(array(a, b)) as doc_id").distinct(), "doc_id", "left_semi"))
    both = pairs.join(held.selectExpr("doc_id as b", "text as text_b"), "b").join(held.selectExpr("doc_id as a", "text as text_a"), "a")
    sides = both.select("text_a", "text_b").mapInArrow(lambda it: linked(it, size, pct), "sig_a binary, sig_b binary").where("sig_a <> sig_b")
    sides = sides.unionByName(sides.selectExpr("sig_b as sig_a", "sig_a as sig_b")).distinct()
    degree = tables.cut(sides.groupBy("sig_a").agg(F.count("*").alias("n_links")).withColumnRenamed("sig_a", "sig"))
    tables.free(every, known, degree)
    return out.join(degree, "sig", "left").drop("sig").withColumn("n_links", F.expr("coalesce(n_links, 0)"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), size=3, pct=90).select("doc_id", "n_shingles", "component_id")


def oracle() -> str:
    """The same by counting the shingles that each pair of documents shares."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{up}', '{low}'), '[^ 	-
]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_of JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.to_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id
FROM (SELECT doc_id, min(to_id) AS least FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""
