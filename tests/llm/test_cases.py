"""Whole queries against brute force, hash traps, damaged inputs, empty tables, clashing columns and repeated rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

pytest.importorskip("thicket.llm")
from thicket.llm import common, components  # noqa: E402
from thicket.llm import op1_surrogates as op1  # noqa: E402
from thicket.llm import op2_urls as op2  # noqa: E402
from thicket.llm import op3_mixing as op3  # noqa: E402
from thicket.llm import op4_transport as op4  # noqa: E402
from thicket.llm import op5_anchors as op5  # noqa: E402
from thicket.llm import op6_decisions as op6  # noqa: E402
from thicket.llm import op7_factors as op7  # noqa: E402
from thicket.llm import op8_chat as op8  # noqa: E402
from thicket.llm import op9_jaccard as op9  # noqa: E402
from thicket.llm import op10_bpe as op10  # noqa: E402
from thicket.llm.wordhash import windows  # noqa: E402

from test_tables import both, rows_of  # noqa: E402
from test_texts import ODD, brute_dedup, brute_join, frame, made, words_of  # noqa: E402

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n)), "".join((b, a)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_polynomials_confuse(spark, size):
    x, y = thue_morse(size, "a", "b")
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"p q {x} z p q {y}"), (4, x), (5, y), (6, f"p q {y} z"), (7, f"{head} {x} end")]
    assert sorted((tuple(r) for r in op5.dedup(frame(spark, rows), digest=True).collect()), key=str) == brute_dedup(rows)
    assert {r.doc_id: r.component_id for r in op9.join(frame(spark, rows), 3, 90).collect()} | {None: None} == brute_join(rows, 3, 90)
    assert op6.measure([rows[2][1].encode()])["n_repeat_words"].tolist() == [0] and op6.measure([rows[2][1].encode()])["n_distinct_words"].tolist() == [5]


def test_hashes_decide_nothing(spark, monkeypatch):
    """With all words of one hash, block anchors and the statistics still give what brute force gives."""
    import numpy as np

    from thicket.llm.wordhash import Chunk

    rows = made(11, 40) + ODD[:5]
    c = Chunk([i for i, _ in rows], [(t or "").encode() for _, t in rows])
    c.hash[:] = 1
    at = np.flatnonzero(c.inside(op5.WINDOW) & c.known[c.doc])
    done = op5.settle(c, windows(c.hash, op5.BLOCK), at)
    seen = [tuple(c.code[i : i + op5.WINDOW]) for i in at]
    assert all(any(s == seen[k] and c.ids[c.doc[at[j]]] < c.ids[c.doc[at[k]]] for j, s in enumerate(seen)) for k in np.flatnonzero(done)[:50])


def test_buckets_grow_with_the_input(spark):
    small, large = op5.sizes(1 << 20), op5.sizes(100 << 40)
    assert small == (10, 4, 3) and large[0] > small[0] and (100 << 40) / 2 ** large[1] <= 4 * op5.DOC_BYTES and large[2] == 4
    rows = made(9, 60)
    docs = frame(spark, rows)
    for size in (1, 1 << 34, 100 << 40):
        op5_sizes = op5.sizes(size)
        assert 8 * op5_sizes[2] + op5_sizes[0] <= 64
        with pytest.MonkeyPatch.context() as m:
            m.setattr(op5, "sizes", lambda n, s=op5_sizes: (s[0], min(s[1], 8), s[2]))
            assert sorted((tuple(r) for r in op5.dedup(docs, digest=True).collect()), key=str) == brute_dedup(rows)


def reader(media):
    """Another reading of a whole stream, packet by packet: payload, timestamps and flags of each unit."""
    tables, units = {}, []
    for k in range(0, len(media), 188):
        p = media[k : k + 188]
        assert p[0] == 0x47
        pid, begins, field, at = int.from_bytes(p[1:3], "big") & 0x1FFF, p[1] >> 6 & 1, p[3] >> 5 & 1, 4
        flags = p[5] if field and p[4] else 0
        if field:
            at = 5 + p[4]
        if pid in (0, tables.get(0)):
            body = p[at + 1 + p[at] :]
            size = int.from_bytes(body[1:3], "big") & 0xFFF
            inside = body[8 : 3 + size - 4]
            tables[pid] = int.from_bytes(inside[2:4] if pid == 0 else inside[5:7], "big") & 0x1FFF
        elif pid == tables[tables[0]]:
            if begins:
                units.append([b"", flags >> 6 & 1])
            units[-1][0] += p[at:]
    out = []
    for pes, key in units:
        t = int.from_bytes(pes[9:14], "big")
        out.append((pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")], (t >> 33 & 7) << 30 | (t >> 17 & 0x7FFF) << 15 | t >> 1 & 0x7FFF, bool(key)))
    return out


@data
def test_transport_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in common.table(spark, SF, "documents").collect()}
    media = {r.doc_id: bytes(r.media) for r in op4.store(common.table(spark, SF, "documents")).collect()}
    got = op4.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        want = raw + b"\0" * (max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        units = reader(media[r.doc_id])
        assert b"".join(u[0] for u in units) == want
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        assert [(u.pid, u.pts, u.random_access, u.size, u.complete) for u in r.units] == [(op4.ES_PID, t, k, len(x), True) for x, t, k in units]
        assert r.feature == f"units={len(units)};random_access={sum(u[2] for u in units)};pts={units[0][1]}-{units[-1][1]};packets={len(media[r.doc_id]) // 188};gaps=0;bad_tables=0;sum={sum(want)};energy={sum(b * b for b in want)}"


def test_transport_damage():
    r = random.Random(4)
    whole = op4.mux(op4.padded(r.randbytes(60_000)))
    clean = op4.demux(whole)
    assert all(u.complete for u in clean.units) and len(clean.units) == 15
    lost = op4.demux(whole[: 188 * 9] + whole[188 * 10 :])
    assert [u.complete for u in lost.units].count(False) == 1 and lost.gaps == 1 and lost.units[1:] == clean.units[1:]
    sixteen = op4.demux(whole[: 188 * 9] + whole[188 * 25 :])  # no counter tells
    assert sixteen.gaps == 0 and [u.complete for u in sixteen.units].count(False) == 1 and not sixteen.units[0].complete
    tail = op4.demux(whole[: -188 * 3])
    assert not tail.units[-1].complete and tail.units[:-1] == clean.units[:-1]
    empty_map = op4.table_packet(op4.PAT_PID, 0) + (bytes([0x47, 0x40 | op4.PMT_PID >> 8, op4.PMT_PID & 255, 0x10, 0]) + op4.section(2, 1, b"")).ljust(188, b"\xff")
    s = op4.demux(empty_map + whole[376:])
    assert s.bad_tables == 1 and op4.feature(op4.demux(b""), b"").startswith("units=0;random_access=0;pts=none")
    for _ in range(400):
        x = bytearray(whole[: 188 * 40])
        for _ in range(r.choice([1, 3, 30])):
            kind, at = r.randrange(3), r.randrange(len(x))
            if kind == 0:
                x[at] = r.randrange(256)
            elif kind == 1:
                del x[at : at + r.choice([1, 50, 188, 500])]
            else:
                x[at:at] = r.randbytes(r.choice([1, 188]))
            if len(x) < 10:
                break
        out = op4.demux(bytes(x))
        op4.feature(out, b"".join(u.data for u in out.units))
    for _ in range(200):
        op4.demux(bytes([0x47]) + r.randbytes(187) + bytes([0x47]) + r.randbytes(187))


def test_names_of_people():
    m = op1.Surrogates()
    new = lambda t: op1.rewritten(t, m)
    text, spans, distinct, clash = new("Dr. Anna Ruiz came. Later Anna Ruiz left; Ruiz paid, and Anna went.")
    assert "Anna" not in text and "Ruiz" not in text and (len(spans), distinct, clash) == (6, 2, 0)
    words = re.findall(r"[A-Z]\w+", text)
    assert words[1:3] == words[4:6] and words[2] == words[6] and words[1] == words[7] and op1.GIVEN[words[1]] == ("latin", "f")
    given = lambda t: new(t)[0].split()[1]
    assert op1.GIVEN[given("Mr. Peter Kim")] == ("latin", "m") and op1.GIVEN[given("Prof. Peter Kim")] == ("latin", "m")
    assert given("Mr. Anna Kim").endswith("old") and given("Mrs. Zelda Kim").endswith("a") and given("Ms. Ingeborg Kim").endswith("ine") and given("Mr. Otto Kim").endswith("o")
    assert given("Prof. Kimber Lee").endswith("ey") and given("Г-жа Ирина Петрова").endswith(tuple("аья")) and given("Г-н Павлик Иванов").endswith("слав")
    assert new("Г-жа Анна Петрова")[0].endswith("а") and new("MR. x")[1] == []
    both_ = new("Dr. Kim Lee, that is Ms. Kim Lee; Kim.")[0]
    assert len(set(re.findall(r"\w+ine\b", both_))) == 1 and "Kim" not in both_
    assert len(new("Prof. Tom Smith Jones Baker Long Name and Herr Karl von der Heide")[1]) == 8
    pool = [a + b + c for a in "ABDIR" for b in ("an", "el", "ira", "olo", "o") for c in ("a", "o", "ine", "old", "ey", "e", "n")] + [n for n, (s, _) in op1.GIVEN.items() if s == "latin"]
    made_ = {(w, g): m.make("name", w, "given", g) for w in pool for g in ("f", "m", "")}
    back = {}
    for (w, g), n in made_.items():
        assert back.setdefault(n, (w, op1.gender_of(w, g))) == (w, op1.gender_of(w, g)) and n != w
    family = [m.make("name", w, "family") for w in pool]
    assert len(set(family)) == len(set(pool))


def test_numbers_and_addresses():
    m = op1.Surrogates()
    forms = ["+493012345678", "+49 30 12345678", "+49-30-12345678", "+49 (30) 12345678"]
    new = [op1.rewritten(f"call {p}.", m)[0][5:-1] for p in forms]
    assert len({op1.plain(x) for x in new}) == 1 and all(x.startswith("+49") for x in new) and op1.plain(new[0]) != op1.plain(forms[0])
    for p in ("+49 301 2345678", "+49-301-2345678", "+1 743 555 3824", "+420 601 123 456"):
        assert [k for _, _, k, *_ in op1.found(f"call {p}.")] == ["phone"]
    for kind, values in {"iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"], "ssn": ["123-45-6789"], "ip6": ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1"[0:0] or "2001:0db8:0000:0000:0000:0000:0000:0001"]}.items():
        for v in values:
            text, spans, _, clash = op1.rewritten(f"it is {v}, yes", m)
            assert [k for k, _, _ in spans] == [kind] and not clash and v not in text
            assert [k for _, _, k, *_ in op1.found(text)] == [kind]
    assert op1.rewritten("2001:db8::1", m)[0] == op1.rewritten("2001:0DB8:0:0:0:0:0:1", m)[0]
    assert not op1.found("at 12:30:45, 10:20, std::vector, aa:bb:cc:dd:ee:ff, 000-12-3456, DE00 3704 0044 0532 0130 00")
    assert [k for _, _, k, *_ in op1.found("mail " + "a" * 90 + "@example.com")] == ["email"]


@data
def test_no_two_entities_meet(spark):
    texts = ["Mrs. Anna Ruiz, a@b.example.com", "Mr. Anna Ruiz +1 (743) 555-3824", "Dr. Anna Ruiz 8.8.8.8", None, ""]
    docs = common.table(spark, SF, "documents").select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert op1.clashes(docs).collect() == []


@data
def test_decisions_query(spark):
    """Counts, learning and verdicts again, in plain Python."""
    docs, labels = common.table(spark, SF, "documents").collect(), {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    stats = {}
    for r in docs:
        t = r.text or ""
        w, lines = words_of(t), [x for x in t.split("\n") if words_of(x)]
        grams, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
        for i in range(len(w) - 2):
            covered |= {i, i + 1, i + 2} if grams[tuple(w[i : i + 3])] > 1 else set()
        n = lambda p, t=t: len(re.findall(p, t))
        stats[r.doc_id] = dict(zip(op6.COUNTS, (len(w), sum(map(len, w)), n(r"[#*$%&|<>]"), len(lines) - len(set(lines)), len(covered), len(lines), len(set(w)), n("[A-Z]"), n("[A-Za-z]"), n("[0-9]"), n("!")), strict=True))

    def features(s):
        w, letters, lines = max(s["n_words"], 1), max(s["n_letters"], 1), max(s["n_lines"], 1)
        return dict(zip(op6.FEATURES, (float(s["n_words"]), s["word_chars"] / w, s["n_symbols"] / w, s["n_bangs"] / w, s["n_upper"] / letters, s["n_digits"] / w, s["n_repeat_words"] / w, s["n_distinct_words"] / w, s["n_dup_lines"] / lines, s["n_words"] / lines), strict=True))

    rows = sorted((i, labels[i] == 0, features(stats[i])) for i in stats if i in labels)
    limits = {f: op6.thresholds(__import__("numpy").array([x[f] for _, _, x in rows])) for f in op6.FEATURES}
    ok = lambda x, rule: all((x[f] > v) == above for f, above, v in rule)
    left, rules = [(k, bad, x) for k, (_, bad, x) in enumerate(rows)], []
    while len(rules) < op6.RULES and sum(b for _, b, _ in left) >= op6.COVER and not all(b for _, b, _ in left):
        grow, prune, rule = [r for r in left if r[0] % 3 != 2], [r for r in left if r[0] % 3 == 2], []
        while len(rule) < 4 and not all(b for _, b, x in grow if ok(x, rule)):
            held, best, most = [r for r in grow if ok(r[2], rule)], None, 1e-9
            p = sum(b for _, b, _ in held)
            for f, values in limits.items():
                for v in values:
                    for above in (True, False):
                        now = [b for _, b, x in held if (x[f] > v) == above]
                        if sum(now) and (gain := sum(now) * (math.log2(sum(now) / len(now)) - math.log2(p / len(held)))) > most + 1e-12:
                            best, most = (f, above, v), gain
            if not best:
                break
            rule.append(best)
        if not rule:
            break
        worth = lambda k: (lambda c: (sum(c) - sum(not b for b in c)) / max(len(c), 1))([b for _, b, x in prune if ok(x, rule[:k])])  # noqa: B023, E731
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if prune else rule  # noqa: B023
        hit = [r for r in left if ok(r[2], rule)]
        new = [b for k, b, _ in hit if k % 3 == 2]
        if len(hit) < op6.COVER or sum(b for _, b, _ in hit) / len(hit) < op6.PRECISION or (new and sum(new) / len(new) < op6.PRECISION):
            break
        rules.append(rule)
        left = [r for r in left if r not in hit]
    assert [[(c.feature, c.above, c.limit) for c in r] for r in op6.fit(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))] == rules
    for r in op6.query(spark, SF).collect():
        s = stats[r.doc_id]
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        assert {c: r[c] for c in op6.COUNTS} == s and r.base_failed == failed and r.kept == (not failed and not any(ok(features(s), rule) for rule in rules))


@data
def test_machine_query(spark):
    """Scores again, all pairs one by one; and quality on rows that the fit has not seen."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    m = op7.fit(docs, labels)
    got = {r.doc_id: r for r in op7.query(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:25]:
        raw = (r.text or "").encode()
        count = Counter(xxhash.xxh3_64_intdigest(w) % op7.WORDS for w in re.findall(rb"[^\x20\x09-\x0D]+", raw.lower()))
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values())) or 1
        x = {p: math.log1p(n) / norm for p, n in count.items()}
        z = m.standard(op7.numbers([raw], __import__("numpy").array([float(r.n_chars or 0)])))[0]
        x |= {op7.WORDS + k: v for k, v in enumerate(z)}
        items = list(x.items())
        total = m.bias + sum(m.w[i] * v for i, v in items) + sum(float(m.v[i] @ m.v[j]) * a * b for k, (i, a) in enumerate(items) for j, b in items[:k])
        score = 1 / (1 + math.exp(-max(min(total, 60), -60)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    sf = "/root/testdata/sf0.1"
    if os.path.isdir(sf):
        held = op7.query(spark, sf).where("held_out").join(common.table(spark, sf, "labels").where("quality is not null"), "doc_id").select("score", "quality").collect()
        good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
        assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.98  # 0.9999 when this was written


def test_repeated_documents_do_not_widen_a_fit(spark):
    docs = spark.createDataFrame([(1, f"text {'ab' * i}! " * (i + 9), i) for i in range(50)] + [(2, "other words " * 30, 0)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op7, "train", lambda row, place, x, stats, y: seen.append(len(y)))
        op7.fit(docs, labels, sample=7)
        m.setattr(op6, "learn", lambda x, bad, order: seen.append(len(bad)))
        op6.fit(docs, labels, sample=7)
    assert seen == [7, 7]


@data
def test_encoding_query(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(op10.vocabulary())
    library.no_truncation()
    want = []
    for r in common.table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in op10.query(spark, SF).collect()) == sorted(want)
    with open(op10.vocabulary(), encoding="utf-8") as f:
        source = f.read()
    with pytest.raises(ValueError):
        op10.Bpe(source.replace('"normalizer":null', '"normalizer":{"type":"NFC"}').replace('"normalizer": null', '"normalizer": {"type":"NFC"}'))


@data
@pytest.mark.parametrize("op", [op5, op9])
def test_sql_of_texts(spark, op):
    both(spark, op, SF)


def test_rules_by_host(spark):
    rules = [(f"h{i}.example.com", f"/p{i % 7}", "block") for i in range(300)] + [("com", "/", "allow"), ("example.com", "/p3/x", "allow"), ("a.b", "", "block")]
    known = op2.Rules(rules)

    def slow(host, path):
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    r = random.Random(2)
    for _ in range(500):
        host = r.choice(["", "www.", "x.y."]) + r.choice([f"h{r.randrange(310)}.example.com", "example.com", "com", "a.b", "ca.b", ""])
        path = r.choice(["", "/", "/p3", "/p3/x/y", f"/p{r.randrange(8)}"])
        assert known.find(host, path) == slow(host, path)


def test_long_conversations(spark):
    r = random.Random(6)
    rows = [(1, t, r.choice(["user", "assistant"]), f"t{t}" * r.randrange(4)) for t in range(900)]
    got = op8.digest(op8.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    said = "".join(x[3] for x in rows if x[2] == "assistant")
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (900, len(said), hashlib.sha256(said.encode()).hexdigest())


EMPTY = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}


def test_empty_tables(spark, tmp_path):
    for name, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for op in (op1, op2, op3, op4, op5, op6, op7, op9, op10):
        assert op.query(spark, str(tmp_path)).collect() == []
    assert [r.conv_id for r in op8.query(spark, str(tmp_path)).collect()] == [-1]
    import corpus_pipeline as c

    assert c.run(spark, str(tmp_path)).collect() == []


CLASH = "key stats verdict pii pii_ gone_id component_id rep sig n size bucket kind data media units place label x own copies epoch last tokens turns p at blocks".split()


def test_clashing_columns_and_repeats(spark, tmp_path):
    """Columns named like those inside, and every row twice, change no result of a row."""
    docs = frame(spark, made(3, 40) + ODD[:4] + [(500, "Mrs. Anna Ruiz " + "w " * 60)], 2).selectExpr("*", "'en' as lang", "if(doc_id % 2 = 0, 'src0', null) as source", "length(text) as n_chars")
    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    more = docs.unionByName(docs).selectExpr("*", *(f"'other' as {c}" for c in CLASH))
    machine, rules = op7.fit(docs, labels), op6.fit(docs, labels)
    path = op10.vocabulary()
    plain = {
        "op1": lambda d: op1.replace(d)[0].select("doc_id", "text"), "op4": lambda d: op4.read(op4.store(d)), "op5": lambda d: op5.dedup(d, digest=True), "op6": lambda d: (lambda j: j.selectExpr("doc_id", f"`{j.columns[-1]}`.*"))(op6.judge(d, rules)),
        "op7": lambda d: op7.score(d, machine), "op9": lambda d: op9.join(d, 3, 90).select("doc_id", "n_shingles", "component_id"), "op10": lambda d: op10.round_trip(d, path),
    }
    for name, fn in plain.items():
        one, two = (rows_of(x.columns, x.collect()) for x in map(fn, (docs, more)))
        assert [r for r in one for _ in (0, 1)] == two, name
    assert rows_of(["doc_id"], op3.select(docs).select("doc_id").distinct().collect()) and op3.mix(more).columns == more.columns
    pages = spark.createDataFrame([(1, "http://a.com/xxx"), (None, None)], "page_id long, url string")
    assert rows_of(["p"], op2.judge(pages.selectExpr("*", "1 as host", "2 as verdict")).select("verdict").collect()) == rows_of(["p"], op2.judge(pages).select("verdict").collect())
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert op8.format_chat(turns.selectExpr("*", "1 as turns", "2 as p", "3 as blocks")).collect() == op8.format_chat(turns).collect()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = made(3, 60) + ODD + [(3000, "Same text here " + "w9 " * 60), (3000, "Same text here " + "w9 " * 60), (3001, "same text here " + "w9 " * 60)]
    docs = frame(spark, rows).selectExpr("*", "'en' as lang", "'src0' as source", "length(text) as n_chars", *(f"'other' as {x}" for x in CLASH))
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in c.near_duplicates(spark, docs, str(tmp_path)).collect())
    group = brute_join(rows, c.WORDS, c.PERCENT)
    want = Counter()
    for (i, t), n in Counter(rows).items():
        if i is None or group[i] == i:
            want[i, t] = n if i is None else 1
    assert kept == want and kept[3000, rows[-2][1]] == 1 and (3001, rows[-1][1]) not in kept
    mixed = Counter(r.doc_id for r in c.mixing(spark, docs, str(tmp_path)).collect())
    chosen = Counter()
    for r in op3.select(docs).collect():
        chosen[r.doc_id] += r.copies
    assert mixed == chosen
    out = c.tokens(spark, docs, str(tmp_path)).collect()
    assert len(out) == len(rows)


def test_unsettled_components_and_unset_folder(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    tables = common.Tables(spark)
    assert {r.component for r in components.components(links, tables).collect()} == {0}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(components, "ROUNDS", 1)
        with pytest.raises(RuntimeError):
            components.components(links, tables)
    tables.free()
    assert not [p for p in os.listdir(tables.top.removeprefix("file://")) if not p.startswith(".")]

    class Cluster:
        class conf:
            get = staticmethod(lambda key, other: other)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)
