"""Substring dedup by fixed-block anchors.

A repeat is a window of WINDOW words that also starts in a document with a smaller doc_id. Any such window holds a whole block of BLOCK words of
that document's non-overlapping blocks, as WINDOW = 2 * BLOCK - 1. So the index holds those blocks alone, with the least doc_id of each, and every
rolling window of BLOCK words probes it. Hits are then extended: around each, in the probing document and in the one that holds the block, the windows of
WINDOW words that hold it are compared, and runs of windows that agree are the maximal exact repeats.

Hashes only nominate. Inside a chunk of documents, windows are compared word by word, and repeats are settled before anything is sent (so a passage
in a third of all documents costs one probe a chunk). Between chunks, windows are one when 96 bits of BLAKE2b over their words agree. Everything that
is dealt out is packed: one row holds all entries of a chunk that fall into one bucket. Verdicts go back as places of windows in a text; texts of one
doc_id are told apart by 32 bits of their digests. Buckets are counted from the bytes of the input, so that what a task holds at once stays the same at
every size.

Null text has no words. A null doc_id has no order: such rows are kept whole and repeat nothing. Equal doc_ids do not repeat each other; rows equal in
doc_id and text get equal results. Documents of fewer than WINDOW words, empty ones too, are kept whole; an empty table gives an empty one. Texts are
never cut: a task holds a whole one. Columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts
from .wordhash import Chunk, U, chunks, hashed, mix, windows

NAME = "op5_fixed_block_anchors"
WINDOW, BLOCK = 13, 7
#: Bytes of a window's digest.
WIDE = 12
#: Bytes of text a bucket of documents, and a bucket of blocks; a row of the index is worth about BLOCK words of text.
DOC_BYTES, BLOCK_BYTES = 2 << 20, 64 << 20
ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
ROW_SQL = "bucket int, kind byte, data binary"


def pack(ids: np.ndarray, rest: np.ndarray) -> bytes:
    """Pairs in order of ids: their number, the first id, the widths of steps and of the rest, the steps of the ids, and the rest (bytes, a row each)."""
    order = np.argsort(ids, kind="stable")
    ids, rest = ids[order], np.ascontiguousarray(rest[order])
    step = np.diff(ids, prepend=ids[:1])
    kind = next(k for k in (1, 2, 4, 8) if k == 8 or step.max() < 1 << 8 * k)
    head = np.array([len(ids), ids[0], kind, rest.shape[1]], dtype=np.int64).tobytes()
    return head + step.astype(f"u{kind}").tobytes() + rest.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, kind, width = np.frombuffer(data, np.int64, 4)
    ids = first + np.cumsum(np.frombuffer(data, f"u{kind}", n, 32).astype(np.int64))
    return ids, np.frombuffer(data, np.uint8, n * width, 32 + n * kind).reshape(n, width)


def low(x: np.ndarray, width: int = 8) -> np.ndarray:
    """The low bytes of whole numbers."""
    return np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def high(rest: np.ndarray) -> np.ndarray:
    """Whole numbers from their low bytes."""
    out = np.zeros((len(rest), 8), dtype=np.uint8)
    out[:, : rest.shape[1]] = rest
    return out.view("<u8").ravel()


def deal(bucket: np.ndarray, ids: np.ndarray, rest: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """A packed row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, ids, rest = bucket[order], ids[order], rest[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return [(int(bucket[a]), kind, pack(ids[a:b], rest[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def batch_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), ROW.types, strict=True)], schema=ROW)


def tags(raw: list[bytes]) -> list[int]:
    """32 bits of each text's digest."""
    return [int.from_bytes(hashlib.blake2b(t, digest_size=4).digest(), "little") for t in raw]


def place(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of a document."""
    return (mix(ids.astype(U)) >> U(64 - bits)).astype(np.int64)


def spread(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """The words that windows of this size cover."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + size, n), minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def settle(c: Chunk, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the windows that start at words at, those that a document of the chunk with a smaller id has as well, word by word.

    A window is two blocks that share a word. Where two windows only share a hash, the later one stays open.
    """
    w = mix(blocks[at] * U(0x9E3779B97F4A7C15) + blocks[at + WINDOW - BLOCK])
    ids = c.ids[c.doc[at]]
    order = np.lexsort((ids, w))
    first = np.flatnonzero(np.diff(w[order], prepend=~w[order[:1]]))
    least = np.repeat(order[first], np.diff(first, append=len(w)))
    later = ids[order] > ids[least]
    a, b = order[later], least[later]
    out = np.zeros(len(at), dtype=bool)
    out[a] = c.same(at[a], at[b], WINDOW)
    return out


def block_rows(it: Iterator[pa.RecordBatch], bits: int, width: int, doc_bits: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: blocks, 1: probes, 2: windows settled inside the chunk, by the document's bucket."""
    for c in chunks(it):
        ok = c.inside(WINDOW) & c.known[c.doc] if len(c.doc) else np.empty(0, dtype=bool)
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        blocks = windows(c.hash, BLOCK)
        done = settle(c, blocks, at)
        rows = []
        if done.any():
            gone = at[done]
            doc = c.doc[gone]
            where = np.array(tags(c.raw), dtype=U)[doc] << U(32) | (gone - c.lo[doc]).astype(U)
            rows += deal(place(c.ids[doc], doc_bits), c.ids[doc], low(where), 2)
        open_ = spread(at[~done], len(c.doc), WINDOW)  # words of windows that are not settled
        part = np.flatnonzero(c.inside(BLOCK) & open_ & c.known[c.doc])
        part = part[open_[part + BLOCK - 1]]
        key, owner = blocks[part], c.ids[c.doc[part]]
        bucket, rest = (key >> U(64 - bits)).astype(np.int64), low(key, width)
        fixed = (part - c.lo[c.doc[part]]) % BLOCK == 0
        rows += deal(bucket[fixed], owner[fixed], rest[fixed], 0) + deal(bucket, owner, rest, 1)
        yield from batch_of(rows)


def runs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in it:
        yield from zip(*(batch.column(x).to_pylist() for x in ROW.names), strict=True)


def least(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values with the least id of each."""
    if not parts:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    ids, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, rest))
    ids, rest = ids[order], rest[order]
    first = np.flatnonzero(np.diff(rest, prepend=~rest[:1]))
    return rest[first], ids[first]


def match(it: Iterator[pa.RecordBatch], bits: int, doc_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of bucket and kind. In each bucket, kind 0 gives the least id of each block, and kind 1 probes.

    Probes with a larger id, and the holder of the least id that they meet, are nominated: the document's id and the block. Kind 2 passes.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    now, parts, keys, ids, hit, held = -1, [], None, None, None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            owner, value = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            yield from batch_of(deal(place(owner, doc_bits), owner, low(value), 1))

    for bucket, kind, data in runs(it):
        if bucket != now:
            if hit is not None and hit.any():
                out.append((ids[hit], keys[hit] | U(now << 64 - bits)))
            now, parts, keys, hit = bucket, [], None, None
        if kind == 2:
            yield from batch_of([(bucket, 2, data)])
            continue
        doc, rest = unpack(data)
        rest = high(rest)
        if kind == 0:
            parts.append((doc, rest))
            if len(parts) % 64 == 0:
                parts = [least(parts)[::-1]]
            continue
        if keys is None:
            keys, ids = least(parts)
            hit, parts = np.zeros(len(keys), dtype=bool), []
        if not len(keys):
            continue
        k = np.minimum(np.searchsorted(keys, rest), len(keys) - 1)
        good = (keys[k] == rest) & (doc > ids[k])
        if good.any():
            hit[k[good]] = True
            out.append((doc[good], rest[good] | U(bucket << 64 - bits)))
            held += int(good.sum())
            if held > 500_000:
                yield from flush()
                held = 0
    if hit is not None and hit.any():
        out.append((ids[hit], keys[hit] | U(now << 64 - bits)))
    yield from flush()


class Texts:
    """The texts of a bucket. base is where a text begins in the line of all different texts of its doc_id, so one number tells a place in any of them."""

    def __init__(self, own: pa.Table):
        self.size, self.data, self.n = own.column("size").to_numpy(), own.column("data"), own.num_rows
        self.doc, self.tag = own.column("doc_id").to_pylist(), own.column("tag").to_numpy()
        ids = np.array([-1 if x is None else x for x in self.doc], dtype=np.int64)
        order = np.lexsort((self.tag, ids))
        new_id, new = np.ones(self.n, dtype=bool), np.ones(self.n, dtype=bool)
        new_id[1:] = np.diff(ids[order]) != 0
        new[1:] = new_id[1:] | (np.diff(self.tag[order]) != 0)
        before = np.concatenate([[0], np.cumsum(np.where(new, self.size[order] + 1, 0))])[:-1]  # a text has no more words than bytes
        first = np.maximum.accumulate(np.where(new, np.arange(self.n), 0))
        start = np.maximum.accumulate(np.where(new_id, np.arange(self.n), 0))
        self.base = np.empty(self.n, dtype=np.int64)
        self.base[order] = before[first] - before[start]
        self.codec = pa.Codec("zstd")

    def raw(self, k: int) -> bytes:
        return self.codec.decompress(self.data[k].as_py(), int(self.size[k]), asbytes=True) if self.size[k] else b""


def by_doc(rows: pa.Table, kind: int) -> Callable[[int | None], np.ndarray]:
    """What a bucket has been sent of this kind, by doc_id."""
    parts = [unpack(d) for d, k in zip(rows.column("data").to_pylist(), rows.column("kind").to_pylist(), strict=True) if k == kind]
    ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    rest = np.concatenate([high(p[1]) for p in parts]) if parts else np.empty(0, U)
    order = np.argsort(ids, kind="stable")
    ids, rest = ids[order], rest[order]
    return lambda doc: rest[:0] if doc is None else rest[np.searchsorted(ids, doc, "left") : np.searchsorted(ids, doc, "right")]


def digests(words: list[bytes], at: np.ndarray) -> np.ndarray:
    """96 bits of BLAKE2b over the words of each window, joined by spaces."""
    start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    whole = memoryview(b" ".join(words))
    ends = zip(start[at].tolist(), (start[at + WINDOW] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.blake2b(whole[a:b], digest_size=WIDE).digest() for a, b in ends]), np.uint8).reshape(-1, WIDE)


def extend(own: pa.Table, hits: pa.Table, mask: int, doc_bits: int) -> pa.Table:
    """Around each hit, the windows that hold it: digest and place, by the digest's bucket."""
    ids, rest = [np.empty(0, np.int64)], [np.empty((0, WIDE + 5), np.uint8)]
    sent, mine = by_doc(hits, 1), Texts(own)
    for k, doc in enumerate(mine.doc):
        if not len(nominated := sent(doc)):
            continue
        words = mine.raw(k).split()
        n = len(words) - WINDOW + 1
        if n <= 0:
            continue
        at = np.flatnonzero(np.isin(windows(hashed(words), BLOCK) & U(mask), nominated))
        at = np.flatnonzero(spread(np.maximum(at - (WINDOW - BLOCK), 0), n, WINDOW - BLOCK + 1))
        ids.append(np.full(len(at), doc, dtype=np.int64))
        rest.append(np.concatenate([digests(words, at), low(at + mine.base[k], 5)], axis=1))
    owner, value = np.concatenate(ids), np.concatenate(rest)
    bucket = (high(value[:, :8]) >> U(64 - doc_bits)).astype(np.int64)
    return pa.Table.from_batches(batch_of(deal(bucket, owner, value, 1)), schema=ROW)


def later(ids: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries in order of digest and id, and which of them have a smaller id of the same digest before them."""
    a, b = high(value[:, :8]), high(value[:, 8:WIDE])
    order = np.lexsort((ids, b, a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    first = np.flatnonzero(new)
    return order, ids[order] > np.repeat(ids[order[first]], np.diff(first, append=len(order)))


def agree(it: Iterator[pa.RecordBatch], doc_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of bucket. Windows that a document with a smaller id has as well go to their document's bucket.

    An entry leaves as soon as a smaller id has been met, so what is held is the distinct windows of a bucket.
    """
    now, parts, held = -1, [], 0

    def settled() -> Iterator[pa.RecordBatch]:
        ids, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, gone = later(ids, value)
        ids, value = ids[order], value[order]
        yield from batch_of(deal(place(ids[gone], doc_bits), ids[gone], value[gone][:, WIDE:], 1))
        parts[:] = [(ids[~gone], value[~gone])]

    for bucket, _, data in runs(it):
        if bucket != now and parts:
            yield from settled()
            parts.clear()
            held = 0
        now = bucket
        parts.append(unpack(data))
        held += len(parts[-1][0])
        if held > 500_000 + 2 * len(parts[0][0]):
            yield from settled()
            held = len(parts[0][0])
    if parts:
        yield from settled()


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])


def finish(own: pa.Table, sent: pa.Table, digest: bool) -> pa.Table:
    schema, rows = (RESULT if digest else TEXTS), []
    agreed, settled, mine = by_doc(sent, 1), by_doc(sent, 2), Texts(own)
    for k, doc in enumerate(mine.doc):
        w = mine.raw(k).split()
        inside, tagged = agreed(doc), settled(doc)
        at = inside.astype(np.int64) - mine.base[k]
        at = np.concatenate([at[(at >= 0) & (at < len(w))], (tagged[tagged >> U(32) == U(mine.tag[k])] & U(0xFFFFFFFF)).astype(np.int64)])
        gone = spread(at, len(w), WINDOW)
        kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g] if len(at) else w)
        if digest:
            rows.append((doc, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        else:
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            rows.append((doc, kept.decode(), edge.reshape(-1, 2).tolist()))
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


OWN = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("size", pa.int64()), ("tag", pa.int64()), ("data", pa.binary())])


def bucketed(it: Iterator[pa.RecordBatch], doc_bits: int) -> Iterator[pa.RecordBatch]:
    """Whole texts, compressed, by their document's bucket; those without a doc_id are sent nothing and spread by their text."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in it:
        ids, raw = batch.column("doc_id").to_pylist(), texts(batch)
        tag = tags(raw)
        b = place(np.array([t if x is None else x for x, t in zip(ids, tag, strict=True)], dtype=np.int64), doc_bits) if ids else []
        data = [codec.compress(t, asbytes=True) if t else b"" for t in raw]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((b, ids, [len(t) for t in raw], tag, data), OWN.types, strict=True)], schema=OWN)


def sizes(n_bytes: int) -> tuple[int, int, int]:
    """Bits of the buckets of blocks and of documents, and bytes of a block's hash beside its bucket, for so many bytes of text.

    The hash is ten bits longer than the number of blocks needs, as a chance hit costs a few digests.
    """
    bits = min(max(int(n_bytes // BLOCK_BYTES).bit_length(), 10), 20)
    doc_bits = min(max(int(n_bytes // DOC_BYTES).bit_length(), 4), 28)
    need = int(n_bytes // (6 * BLOCK)).bit_length() + 10
    return bits, doc_bits, min(max(-(-(need - bits) // 8), 3), 5)


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, kept_text and the removed spans of words (maximal exact repeats); digest: the counts and digest of the query."""
    spark = prepare(docs.sparkSession)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    bits, doc_bits, width = sizes(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    mask = (1 << 8 * width) - 1 | (1 << bits) - 1 << 64 - bits
    ordered = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    settled = docs.mapInArrow(lambda it: block_rows(it, bits, width, doc_bits), ROW_SQL)
    hits = ordered(settled).mapInArrow(lambda it: match(it, bits, doc_bits), ROW_SQL)
    own = docs.mapInArrow(lambda it: bucketed(it, doc_bits), "bucket int, doc_id long, size long, tag long, data binary").groupBy("bucket")
    with_texts = lambda sent, fn, out: own.cogroup(sent.groupBy("bucket")).applyInArrow(fn, out)  # noqa: E731  one shuffle of texts serves both
    around = with_texts(hits.where("kind = 1"), lambda a, b: extend(a, b, mask, doc_bits), ROW_SQL)
    agreed = ordered(around).mapInArrow(lambda it: agree(it, doc_bits), ROW_SQL)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else "doc_id long, kept_text string, spans array<array<int>>"
    return with_texts(agreed.unionByName(hits.where("kind = 2")), lambda a, b: finish(a, b, digest), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digest=True)


def oracle() -> str:
    """The same by joining whole windows as texts."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
first_of AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN first_of USING (s) CROSS JOIN range({WINDOW}) r(k) WHERE doc_id > least),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
