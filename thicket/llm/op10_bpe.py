"""BPE encoding and decoding by a contiguous rank array.

A word's parts are held in one list, as the tokens between its boundaries, beside the list of the ranks of adjacent pairs. That is scanned for its least
rank, the boundary there is deleted, and the two ranks around it are looked up again. Above LONG bytes that scan would be quadratic, so long words use a heap over a linked
list, which merges in the same order. Words come from the usual byte-level pattern; special tokens of the vocabulary file are split off first.

The vocabulary file is read where the query is made and broadcast (some 2 MB, a size that the corpus does not change); a file of another kind than
byte-level BPE without a normaliser is refused.

Nulls count as the empty text, whose tokens are none; a null doc_id stays null. Rows stay as they are: repeated rows give repeated results, an empty
table an empty one. Texts are encoded whole, some 200 bytes of memory a token. Columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import lines, prepare, table, texts

NAME = "op10_bpe_rank_array"
#: Bytes from which a word is merged through a heap.
LONG = 128
#: Words whose tokens a worker remembers; then it starts afresh.
MEMORY = 400_000
#: The rank of a pair that does not merge.
NONE = 1 << 30
#: The pattern of byte-level BPE, and the same for texts that are ASCII throughout.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, source: str):
        """source: the text of a vocabulary file."""
        spec = json.loads(source)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain:
            raise ValueError("only byte-level BPE with its own pattern and without a normaliser")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens are to be taken as they are")
        byte = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        of = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.ranks = {of[a] << 32 | of[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [of[a + b] for a, b in pairs]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pieces = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words, self.ascii = regex.compile(PATTERN).findall, re.compile(ASCII).findall
        self.digits = [str(i) for i in range(max(self.pieces) + 1)]
        self.known: dict[str, tuple[int, ...]] = {}

    def rank(self, a: int, b: int) -> int:
        return self.ranks.get(a << 32 | b, NONE)

    def merge(self, word: bytes) -> list[int]:
        return self.scan(word) if len(word) <= LONG else self.heap(word)

    def scan(self, word: bytes) -> list[int]:
        """part holds the tokens between the boundaries that are left; near[i] is the rank of parts i and i+1."""
        get, part = self.ranks.get, list(map(self.single.__getitem__, word))
        near = [get(a << 32 | b, NONE) for a, b in zip(part, part[1:], strict=False)]
        while near and (least := min(near)) < NONE:
            i = near.index(least)
            part[i] = own = self.merged[least]
            del part[i + 1], near[i]
            if i < len(near):
                near[i] = get(own << 32 | part[i + 1], NONE)
            if i:
                near[i - 1] = get(part[i - 1] << 32 | own, NONE)
        return part

    def heap(self, word: bytes) -> list[int]:
        n, rank = len(word), self.rank
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), list(map(self.single.__getitem__, word))
        todo = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank(part[i], part[i + 1])) < NONE]
        heapq.heapify(todo)
        while todo:
            r, i, a, b = heapq.heappop(todo)
            if part[i] != a or (j := after[i]) >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = self.merged[r], -1, after[j]
            if (j := after[i]) < n:
                before[j] = i
                if (r := rank(part[i], part[j])) < NONE:
                    heapq.heappush(todo, (r, i, part[i], part[j]))
            if (h := before[i]) >= 0 and (r := rank(part[h], part[i])) < NONE:
                heapq.heappush(todo, (r, h, part[h], part[i]))
        return [p for p in part if p >= 0]

    def word(self, w: str) -> tuple[int, ...]:
        out = self.known.get(w)
        if out is None:
            raw = w.encode("utf-8")
            out = tuple(self.merge(raw))
            if len(self.known) >= MEMORY:
                self.known.clear()
            if len(raw) <= LONG:
                self.known[w] = out
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, s in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                out.append(self.special[s])
            elif s:
                out += chain.from_iterable(map(self.word, (self.ascii if s.isascii() and not self.odd(s) else self.words)(s)))
        return out

    @staticmethod
    def odd(s: str) -> bool:
        return any(c in s for c in "\x1c\x1d\x1e\x1f")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(source: str) -> Bpe:
    return Bpe(source)


def shared(spark: SparkSession, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return prepare(spark).sparkContext.broadcast(f.read())


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(source: Broadcast) -> Callable:
    def fn(batch: pa.RecordBatch) -> list:
        bpe, n, ids_sha, text_sha = model(source.value), [], [], []
        for raw in texts(batch):
            ids = bpe.encode(raw.decode("utf-8", "replace"))
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [batch.column("doc_id"), n, ids_sha, text_sha]

    return lambda it: lines(it, fn, SCHEMA)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int): the operator itself."""
    schema, source = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), shared(docs.sparkSession, path)
    fn = lambda b: [b.column("doc_id"), [model(source.value).encode(t.decode("utf-8", "replace")) for t in texts(b)]]
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lambda it: lines(it, fn, schema), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    schema, source = pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), shared(rows.sparkSession, path)
    fn = lambda b: [b.column("doc_id"), [model(source.value).decode(x or []) for x in b.column("ids").to_pylist()]]
    return rows.select("doc_id", "ids").mapInArrow(lambda it: lines(it, fn, schema), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The digests of what each text encodes to and of what that decodes to."""
    source = shared(docs.sparkSession, path)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(digests(source), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())
