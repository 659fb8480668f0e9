"""Media columns: MPEG transport streams.

mux() writes a payload as one program: a program association table, a program map table, and one elementary stream of access units in packetised
form, each with a timestamp; every GROUP-th unit starts with a clock reference and the random-access flag, behind fresh tables. demux() takes any
transport stream: it finds packet sync, parses the tables (with their CRC), checks continuity counters, drops repeated packets, reassembles
elementary packets, and returns the units with timestamps and random-access points. Damage is counted, never raised: a unit that has lost bytes, by its
counters or by the length that it states, is marked as not complete. (Lost packets that no counter and no length betrays, such as whole units with
sixteen packets, only show in the timestamps.)

Null and empty texts are an empty text: 64 zero bytes. A null doc_id stays null. Equal texts, repeated rows too, give equal streams. Empty tables give
empty tables. A task holds a few copies of one whole text and its stream. Columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lines, prepare, table, texts

NAME = "op4_transport_stream"
#: Bytes of an access unit, units between random-access points, clock ticks (of 90 kHz) between units.
UNIT, GROUP, TICKS = 4096, 8, 3600
#: Fixed values of the format: packet size, sync byte, table PIDs, stream type and id of private data, polynomial of its CRC.
SIZE, SYNC, PAT_PID, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID, POLY = 188, 0x47, 0x0000, 0x1000, 0x0101, 0x06, 0xBD, 0x04C11DB7


@lru_cache(maxsize=256)
def crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1) ^ POLY if c & 0x80000000 else c << 1
        c &= 0xFFFFFFFF
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    data = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return data + crc(data).to_bytes(4, "big")


@lru_cache(maxsize=64)
def table_packet(pid: int, counter: int) -> bytes:
    if pid == PAT_PID:
        data = section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    else:
        data = section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return (head + data).ljust(SIZE, b"\xff")


def stamp(pts: int) -> bytes:
    """A timestamp's 33 bits between its marker bits."""
    pts %= 1 << 33
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    out, counter = [], 0
    for k in range(0, max(len(payload), 1), UNIT):
        data, unit = payload[k : k + UNIT], k // UNIT
        pts, key = 90_000 + unit * TICKS, unit % GROUP == 0
        if key:
            out += [table_packet(PAT_PID, unit // GROUP & 15), table_packet(PMT_PID, unit // GROUP & 15)]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + data
        clock = pts - TICKS
        extra = bytes([0x50, clock >> 25 & 255, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255, (clock & 1) << 7 | 0x7E, 0]) if key else b""
        first = min(len(pes), 184 - (len(extra) + 1 if key else 0))
        n_full, last = divmod(len(pes) - first, 184)
        if first < 184:
            need = 183 - first  # bytes of the adaptation field behind its length
            field_ = (extra or (b"\0" if need else b"")).ljust(need, b"\xff")
            out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter, need]) + field_ + pes[:first])
        else:
            out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x10 | counter]) + pes[:first])
        if n_full:
            block = np.empty((n_full, SIZE), dtype=np.uint8)
            block[:, :3] = (SYNC, ES_PID >> 8, ES_PID & 255)
            block[:, 3] = 0x10 | (counter + 1 + np.arange(n_full)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, n_full * 184, first).reshape(n_full, 184)
            out.append(block.tobytes())
        if last:
            need = 183 - last
            field_ = (b"\0" if need else b"").ljust(need, b"\xff")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | (counter + 1 + n_full) & 15, need]) + field_ + pes[len(pes) - last :])
        counter = (counter + 1 + n_full + bool(last)) & 15
    return b"".join(out)


class Unit(NamedTuple):
    pid: int
    pts: int | None
    random_access: bool
    data: bytes
    complete: bool


@dataclass
class Stream:
    programs: dict[int, dict[int, int]] = field(default_factory=dict)  # PMT PID: {elementary PID: stream type}
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    lost_sync: int = 0
    bad_tables: int = 0
    gaps: int = 0  # jumps of a counter, payloads without a beginning, and beginnings that are none
    repeats: int = 0


def packets(media: bytes) -> tuple[np.ndarray, int]:
    """Packets in sync, and the bytes that are in none."""
    if len(media) % SIZE == 0:
        rows = np.frombuffer(media, np.uint8).reshape(-1, SIZE)
        if (rows[:, 0] == SYNC).all():
            return rows, 0
    found, k = [], 0
    while k + SIZE <= len(media):
        if media[k] == SYNC and (k + SIZE == len(media) or k + SIZE < len(media) and media[k + SIZE] == SYNC or found and found[-1] == k - SIZE):
            found.append(k)
            k += SIZE
        else:
            k = media.find(b"\x47", k + 1)
            if k < 0:
                break
    rows = np.frombuffer(b"".join(media[k : k + SIZE] for k in found), np.uint8).reshape(-1, SIZE)
    return rows, len(media) - rows.size


def parse_sections(rows: np.ndarray, start: np.ndarray, begins: np.ndarray, table_id: int) -> tuple[list[bytes], int]:
    """Bodies of the different valid sections in the packets of one PID, and how many are damaged. A section may span packets, and a packet hold several."""
    good, bad, last, buf = {}, {}, None, b""

    def take(data: bytes) -> bytes:
        """What is left behind the whole sections: the beginning of one, or nothing."""
        while data and data[0] != 0xFF:
            size = 3 + ((data[1] & 15) << 8 | data[2]) if len(data) > 2 else 0
            if not 0 < size <= len(data):
                return data
            one, data = data[:size], data[size:]
            if size >= 12 and crc(one[:-4]) == int.from_bytes(one[-4:], "big"):
                if one[0] == table_id:
                    good[one[8:-4]] = None
            elif one[0] == table_id or one[1] & 0x80:  # others may have no CRC
                bad[one] = None
        return b""

    for r, s, begin in zip(rows, start, begins, strict=True):
        data, count = r[s:].tobytes(), int(r[3]) & 15
        if last == (count, data):
            continue
        if last and (count - last[0]) & 15 != 1 and buf:
            bad[buf], buf = None, b""
        last = count, data
        if begin:
            skip = 1 + data[0] if data else 1
            if buf and (buf := take(buf + data[1:skip])):
                bad[buf] = None
            if skip >= len(data):
                bad[data] = None
            buf = take(data[skip:])
        elif buf:
            buf = take(buf + data)
    if buf:
        bad[buf] = None
    return list(good), len(bad)


def demux(media: bytes) -> Stream:
    out = Stream()
    rows, out.lost_sync = packets(media)
    out.packets = len(rows)
    if not len(rows):
        return out
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    begins, adapt, holds = rows[:, 1] & 0x40 > 0, rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    start = np.minimum(np.where(adapt, 5 + rows[:, 4].astype(np.int32), 4), SIZE)
    key = adapt & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)
    told = adapt & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 > 0)  # counters may jump here
    at = np.flatnonzero((pid == PAT_PID) & holds)
    bodies, out.bad_tables = parse_sections(rows[at], start[at], begins[at], 0)
    for body in bodies:
        for k in range(0, len(body) - 3, 4):
            if body[k] << 8 | body[k + 1]:
                out.programs[(body[k + 2] & 0x1F) << 8 | body[k + 3]] = {}
    for p in out.programs:
        at = np.flatnonzero((pid == p) & holds)
        bodies, bad = parse_sections(rows[at], start[at], begins[at], 2)
        out.bad_tables += bad
        for body in bodies:
            if len(body) < 4:
                out.bad_tables += 1
                continue
            k = 4 + ((body[2] & 15) << 8 | body[3])
            while k + 5 <= len(body):
                out.programs[p][(body[k + 1] & 0x1F) << 8 | body[k + 2]] = body[k]
                k += 5 + ((body[k + 3] & 15) << 8 | body[k + 4])
    for p in dict.fromkeys(x for streams in out.programs.values() for x in streams):
        at = np.flatnonzero((pid == p) & holds)
        if not len(at):
            continue
        count = rows[at, 3] & 15
        again = np.zeros(len(at), dtype=bool)
        again[1:] = (count[1:] == count[:-1]) & (rows[at[1:], 4:] == rows[at[:-1], 4:]).all(axis=1)
        out.repeats += int(again.sum())
        at, count = at[~again], count[~again]
        jump = np.zeros(len(at), dtype=bool)
        jump[1:] = ((np.diff(count) & 15) != 1) & ~told[at[1:]]
        out.gaps += int(jump.sum())
        data = rows[at][np.arange(SIZE) >= start[at, None]]
        ends = np.cumsum(SIZE - start[at])
        heads = np.flatnonzero(begins[at])
        out.gaps += int(not len(heads) or heads[0] > 0)
        for i, h in enumerate(heads):
            after = int(heads[i + 1]) if i + 1 < len(heads) else len(at)
            pes = data[int(ends[h] - (SIZE - start[at[h]])) : int(ends[after - 1])].tobytes()
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                out.gaps += 1
                continue
            size, skip, pts = pes[4] << 8 | pes[5], 9 + pes[8], None
            if pes[7] & 0x80 and len(pes) >= 14:
                t = pes[9:14]
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            whole = not jump[h + 1 : after].any() and (len(pes) == 6 + size if size else not jump[after : after + 1].any())
            out.units.append(Unit(p, pts, bool(key[at[h]]), pes[skip : 6 + size] if size else pes[skip:], whole))
    return out


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
UNIT_ROW = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("size", pa.int32()), ("complete", pa.bool_())])
UNITS = "array<struct<pid: int, pts: bigint, random_access: boolean, size: int, complete: boolean>>"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as a transport stream."""
    prepare(docs.sparkSession)
    fn = lambda b: [b.column("doc_id"), [len(t) for t in texts(b)], [mux(padded(t)) for t in texts(b)]]
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(lambda it: lines(it, fn, MEDIA), "doc_id long, n_bytes long, media binary")


def unit_rows(s: Stream) -> list[dict]:
    return [{"pid": u.pid, "pts": u.pts, "random_access": u.random_access, "size": len(u.data), "complete": u.complete} for u in s.units]


def read(media: DataFrame) -> DataFrame:
    """doc_id, payload, units (timestamps and random-access points), gaps, bad_tables, lost_sync from doc_id, media; null media: no packets."""
    schema = pa.schema([("doc_id", pa.int64()), ("payload", pa.binary()), ("units", pa.list_(UNIT_ROW)), ("gaps", pa.int64()), ("bad_tables", pa.int64()), ("lost_sync", pa.int64())])

    def fn(b: pa.RecordBatch) -> list:
        s = [demux(x) for x in texts(b, "media")]
        return [b.column("doc_id"), [b"".join(u.data for u in x.units) for x in s], [unit_rows(x) for x in s], [x.gaps for x in s], [x.bad_tables for x in s], [x.lost_sync for x in s]]

    prepare(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(lambda it: lines(it, fn, schema), f"doc_id long, payload binary, units {UNITS}, gaps long, bad_tables long, lost_sync long")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("units", pa.list_(UNIT_ROW))])


def feature(s: Stream, payload: bytes) -> str:
    x, stamps = np.frombuffer(payload, np.uint8).astype(np.int64), [u.pts for u in s.units if u.pts is not None]
    span = f"{stamps[0]}-{stamps[-1]}" if stamps else "none"
    return f"units={len(s.units)};random_access={sum(u.random_access for u in s.units)};pts={span};packets={s.packets};gaps={s.gaps};bad_tables={s.bad_tables};sum={x.sum()};energy={(x * x).sum()}"


def digest(batch: pa.RecordBatch) -> list:
    cols: list[list] = [[] for _ in range(7)]
    for media in texts(batch, "media"):
        s = demux(media)
        payload = b"".join(u.data for u in s.units)
        for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s, payload), unit_rows(s)), strict=True):
            c.append(v)
    return [batch.column("doc_id"), batch.column("n_bytes"), *cols]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units {UNITS}"
    return store(table(spark, sf_dir, "documents")).mapInArrow(lambda it: lines(it, digest, DIGEST), out)
