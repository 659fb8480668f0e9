"""PII: keyed surrogates of the same type and format.

Entities (emails, phone numbers, payment cards, IBANs, social security numbers, IPv4 and IPv6 addresses, secrets, names behind a title) become other
entities of their kind. Each replacement is a keyed permutation of the set of values that share type and format, so one entity is always the same
surrogate, in every document and on every executor (coreference), and two entities never meet in one (distinctness); nothing need be looked up or
shuffled. The permutations have no fixed points. Digits stay digits, case and accents stay, separators stay; cards keep their first digit and their
check digit's validity, IBANs their country and theirs, addresses their class (private, public, ...), phone numbers their country code, whatever
separates it.

A name's first word is a given name if others follow, and its last word a family name; a title's word alone is one. Given names keep script and
gender, which the title tells, or else a list, or else the ending: listed ones become listed ones, others are spelled anew, vowels for vowels and
consonants for consonants, with an ending of their gender. Family names are spelled anew in the same way; Cyrillic ones keep their last letter. Once
a title has told a name, every later mention of it in the text is found too: the whole name, and its family or only given name alone.

Collision checks: each document's pairs are checked both ways, and the number of clashes is returned; clashes() does the same for a whole corpus. A
value other than 0 would be a defect.

Null texts stay null, empty texts empty; texts without entities come back unchanged. Equal texts, repeated rows too, give equal results. Other columns
pass through replace() unharmed, and the new one takes a name that no column has; an empty table gives an empty one. Texts are never cut: a task
holds a few copies of a whole one.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, unused

NAME = "op1_surrogate_generation"
#: The key of the registered query; a deployment passes its own secret.
KEY = b"thicket-demonstration-key"
ROUNDS = 8

#: Given names by script and gender, and titles with the gender they tell.
NAMES = {
    ("latin", "f"): "Alice Anna Carmen Clara Elena Emma Eva Ingrid Isabel Julia Laura Lucia Maria Marie Martha Olivia Paula Rosa Sarah Sophie".split(),
    ("latin", "m"): "Albert Anton Carlos David Emil Felix Hugo Jacob James John Jorge Karl Louis Luis Martin Oscar Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("cyrillic", "m"): "Антон Борис Иван Игорь Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Г-н": "m", "Г-жа": "f", "Κύριος": "m", "Κυρία": "f"}
GIVEN = {n: key for key, names in NAMES.items() for n in names}
#: Letters of each script that names are spelled with.
SCRIPTS = {"latin": "abcdefghijklmnopqrstuvwxyz", "accented": "àáâäçèéêëìíîïñòóôöùúûüß", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "greek accented": "άέήίόύώ"}
SCRIPT_OF = {c: s for s, letters in SCRIPTS.items() for c in letters}
VOWELS = frozenset("aeiouyàáâäèéêëìíîïòóôöùúûüаеиоуыэюяαεηιουωάέήίόύώ")
#: The last letter that tells a gender in a script, and what a given name without it is told by. No listed name ends in the latter.
ENDINGS = {"latin": {"f": ("a", "ine"), "m": ("o", "old"), "": ("", "ey")}, "cyrillic": {"f": ("а", "ея"), "m": ("", "слав"), "": ("", "ич")}, "greek": {"f": ("α", "ούλη"), "m": ("ς", "ίων"), "": ("", "άκι")}}
#: Country codes of one and of two digits; the others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

HEX = r"(?:[0-9A-Fa-f]{32,})"
#: Fixed beginnings of common key formats, each with what follows.
KEYS = r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z_-]{20,}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})"
LEAD = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_(?:live|test)_|xox[abprs]-|AIza")
TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
#: Phone numbers of other groups: international ones of 8 to 15 digits, then national ones in fives of pairs, with a trunk 0, and as 3-2-2-2.
GROUPED = (
    r"(?<![\w+.-])\+(?=(?:[ ./()-]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ ./-]?\d{1,8}){1,7}(?![\w-])"
    r"|(?<![\w+.-])(?<!\d )(?:0[1-9](?P<gap>[ .-])\d\d(?:(?P=gap)\d\d){3}|\(?0\d{2,4}\)?[ /-]\d{3,4}[ -]?\d{3,4}|[6-9]\d\d \d\d \d\d \d\d)(?![\w-])(?! \d)"
)
CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+"
LINK = r"(?:[ -]| (?:(?:de|del|della|la|van|von|der|den|di|da|dos|du|y) )+)"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", re.A),
    "secret": re.compile(rf"(?<![0-9A-Za-z])(?:{HEX}|{KEYS})(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![\w-])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])", re.A),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)", re.A),
    "ip6": re.compile(r"(?<![\w.:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|[0-9A-Fa-f]{1,4})(?:(?<=:)[0-9A-Fa-f]{1,4}|:[0-9A-Fa-f]{1,4})*(?![\w:])", re.A),
    "ssn": re.compile(r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])|\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{3,4}(?![\w-])|(?<![\w+.-])\+\d{8,15}(?![\w-])|" + GROUPED, re.A),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])", re.A),
    "name": re.compile(rf"(?<!\w)(?P<title>{TITLE})\.? (?P<name>{CAPITAL}(?:{LINK}{CAPITAL})*)(?!\w)"),
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": re.compile("@"), "ip6": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"), "iban": re.compile(r"[A-Z]{2}\d\d"), "ssn": re.compile(r"\d-\d\d-\d"), "name": re.compile(rf"(?:{TITLE})\.? ")}


@lru_cache(maxsize=200_000)
def round_value(key: bytes, tweak: str, i: int, size: int, half: int) -> int:
    text = f"{tweak}|{i}|{size}|{half}".encode()
    if size <= 1 << 128:
        return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=16).digest()) % size
    wide = b"".join(hashlib.blake2b(text + b"|%d" % k, key=key).digest() for k in range(size.bit_length() // 512 + 2))  # else a long value's first digits would stay
    return int.from_bytes(wide) % size


def feistel(key: bytes, tweak: str, x: int, a: int, b: int, back: bool) -> int:
    """A keyed permutation of range(a * b) by alternating modular additions to both parts."""
    u, v = divmod(x, b)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            u = (u + sign * round_value(key, f"{tweak}|{v}|{b}", i, a, 0)) % a
        else:
            v = (v + sign * round_value(key, f"{tweak}|{u}|{a}", i, b, 1)) % b
    return u * b + v


def permute(key: bytes, tweak: str, digits: list[int], radixes: list[int]) -> list[int]:
    """Another list of digits below the same radixes: a permutation of all of them without fixed points (a step of one, seen through another)."""
    a = b = 1
    for i, r in enumerate(radixes):
        if i < (len(radixes) + 1) // 2:
            a *= r
        else:
            b *= r
    if a * b < 2:
        return digits
    x = 0
    for d, r in zip(digits, radixes, strict=True):
        x = x * r + d
    y = feistel(key, tweak, (feistel(key, tweak, x, a, b, False) + 1) % (a * b), a, b, True)
    out = []
    for r in reversed(radixes):
        y, d = divmod(y, r)
        out.append(d)
    return out[::-1]


def spell(key: bytes, tweak: str, text: str, sound: bool = False) -> str:
    """Letters become letters of their script and case (with sound, vowels vowels), ASCII digits digits; all else stays, and tells formats apart."""
    places, digits, radixes, shape = [], [], [], []
    for i, c in enumerate(text):
        low = c.lower()
        script = "0123456789" if c in "0123456789" else SCRIPTS[SCRIPT_OF[low]] if low in SCRIPT_OF else None
        upper = c != low and low.upper() == c
        if script is None or (c != low and not upper) or (script == SCRIPTS["accented"] and low == "ß"):
            shape.append(c)
            continue
        script = script.replace("ß", "")
        if sound and not c.isdigit():
            script = "".join(x for x in script if (x in VOWELS) == (low in VOWELS))
        places.append((i, script, upper))
        digits.append(script.index(low))
        radixes.append(len(script))
        shape.append(f"{script[0]}{int(upper)}")
    out = list(text)
    for (i, script, upper), d in zip(places, permute(key, tweak + "".join(shape), digits, radixes), strict=True):
        out[i] = script[d].upper() if upper else script[d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The sum whose last digit is 0 for a valid number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def laid_over(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def plain(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def numbers(key: bytes, tweak: str, digits: str) -> str:
    return "".join(map(str, permute(key, tweak, [int(c) for c in digits], [10] * len(digits))))


def address_class(x: int) -> str:
    a, b = x >> 24, x >> 16 & 255
    if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168:
        return "private"
    return "loopback" if a == 127 else "reserved" if a in (0, 255) else "multicast" if a >= 224 else "public"


class Surrogates:
    """Surrogates of one key."""

    def __init__(self, key: bytes = KEY):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.of = lru_cache(maxsize=100_000)(self.make)

    def make(self, kind: str, text: str, role: str = "", gender: str = "") -> str:
        return getattr(self, kind)(text) if kind != "name" else self.name(text, role, gender)

    def email(self, text: str) -> str:
        """Mailbox and domain are spelled anew apart from the last label, and from `example` before it; case does not tell boxes apart."""
        box, _, domain = text.rpartition("@")
        labels = domain.split(".")
        fixed = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
        tail = ".".join(labels[-fixed:])
        host = ".".join(labels[:-fixed])
        new_box = spell(self.key, "box", box.lower())
        new_host = spell(self.key, f"host{tail.lower()}", host.lower()) if host else ""
        return self.cased(box, new_box) + "@" + (self.cased(host, new_host) + "." if host else "") + tail

    @staticmethod
    def cased(old: str, new: str) -> str:
        return "".join(n.upper() if o.isupper() else n for o, n in zip(old, new, strict=True))

    def secret(self, text: str) -> str:
        """Keys keep the beginning that tells their kind; in hex, case does not tell values apart."""
        if lead := LEAD.match(text):
            return lead[0] + spell(self.key, f"secret{lead[0]}", text[lead.end() :])
        hexes = "0123456789abcdef"
        new = "".join(hexes[d] for d in permute(self.key, "secret", [hexes.index(c) for c in text.lower()], [16] * len(text)))
        return new.upper() if text == text.upper() != text.lower() else self.cased(text, new)

    def phone(self, text: str) -> str:
        """International numbers keep their country code; one number has one surrogate, however it is set."""
        digits, code = plain(text), 0
        if text.startswith("+"):
            code = 1 if digits[:1] in CODES else 2 if digits[:2] in CODES else 3
        new = digits[code:]
        ok = lambda s: s[0] in "23456789"
        start = ok(new)
        while True:  # on to the next number that starts like this one: still a permutation
            new = numbers(self.key, f"phone{digits[:code]}", new)
            if ok(new) == start:
                return laid_over(text, digits[:code] + new)

    def ssn(self, text: str) -> str:
        new = plain(text)
        while True:
            new = numbers(self.key, "ssn", new)
            if PATTERNS["ssn"].fullmatch(shown := laid_over(text, new)):
                return shown

    def iban(self, text: str) -> str:
        """Country and groups stay, letters stay letters, the check digits are right."""
        flat = text.replace(" ", "")
        body = spell(self.key, f"iban{flat[:2]}", flat[4:])
        it = iter(flat[:2] + f"{98 - residue(body + flat[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(it) for c in text)

    def ip6(self, text: str) -> str:
        """The first 16 bits stay, which tell the kind of address; short forms come out whole."""
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        new = groups[:1] + permute(self.key, f"ip6{groups[0]}", groups[1:], [1 << 16] * 7)
        return ":".join(f"{g:x}" for g in new)

    def card(self, text: str) -> str:
        digits = plain(text)
        new = digits[0] + numbers(self.key, f"card{digits[0]}", digits[1:-1])
        return laid_over(text, new + str((int(digits[-1]) + luhn(digits[:-1] + "0") - luhn(new + "0")) % 10))

    def ip(self, text: str) -> str:
        parts = [int(p) for p in text.split(".")]
        kind = address_class(int.from_bytes(bytes(parts)))
        keep = 0 if kind == "public" else 1 if kind != "private" or parts[0] == 10 else 2
        new = parts
        while True:
            new = parts[:keep] + permute(self.key, f"ip{parts[:keep]}", new[keep:], [256] * (4 - keep))
            if address_class(int.from_bytes(bytes(new))) == kind:
                return ".".join(map(str, new))

    def name(self, word: str, role: str, gender: str) -> str:
        """One word of a name: a given name of its script and gender, or a family name."""
        if word.isupper() and len(word) > 1:
            return self.name(word[0] + word[1:].lower(), role, gender).upper()
        script = next((SCRIPT_OF[c].split(" ")[0].replace("accented", "latin") for c in word.lower() if c in SCRIPT_OF), "")
        if role == "family" or not script:
            keep = 1 if script == "cyrillic" else 0
            return spell(self.key, "family" + word[len(word) - keep :], word[: len(word) - keep], True) + word[len(word) - keep :]
        own = GIVEN.get(word)
        gender = gender_of(word, gender)
        if own and own[1] == gender:
            return NAMES[own][permute(self.key, f"name{own}", [NAMES[own].index(word)], [len(NAMES[own])])[0]]
        end, added = ENDINGS[script][gender]
        if not own and end and word.endswith(end) and len(word) > len(end) + 1:
            new = word[: -len(end)]
            while True:  # on past listed names, which listed names become
                new = spell(self.key, f"given{end}", new, True)
                if new + end not in GIVEN:
                    return new + end
        return spell(self.key, f"given{added}", word, True) + added


def residue(body: str) -> int:
    """Modulo 97, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in body)) % 97


def gender_of(word: str, told: str) -> str:
    """What a title, the list or the ending tells of a given name."""
    own, low = GIVEN.get(word.title() if word.isupper() else word), word.lower()
    script = next((SCRIPT_OF[c].split(" ")[0].replace("accented", "latin") for c in low if c in SCRIPT_OF), "")
    return told or (own[1] if own else next((g for g in "fm" if script and (end := ENDINGS[script][g][0]) and low.endswith(end)), ""))


def names(title: str, text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, role and gender, as the title tells it, of each word of a name."""
    words = list(re.finditer(CAPITAL, text))
    last = len(words) - 1
    return [(m.start(), m.end(), "family" if i == last else "given", TITLES[title] if i < last else "") for i, m in enumerate(words)]


def valid(kind: str, text: str) -> bool:
    """What a pattern alone can't tell."""
    if kind == "card":
        return luhn(plain(text)) % 10 == 0
    if kind == "iban":
        flat = text.replace(" ", "")
        return 15 <= len(flat) <= 34 and residue(flat[4:] + flat[:4]) == 1
    if kind == "ip6":
        try:
            return len(text) > 4 and ipaddress.IPv6Address(text) is not None
        except ValueError:
            return False
    return True


def found(text: str) -> list[tuple[int, int, str, str, str]]:
    """Start, end, kind, and a name's role and gender, of the entities, without overlaps: the earlier pattern and then the earlier place win."""
    out: list[tuple[int, int, str, str, str]] = []
    taken = bytearray(len(text))

    def take(a: int, b: int, kind: str, role: str = "", gender: str = "") -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, kind, role, gender))

    people: dict[str, tuple[str, str]] = {}
    for kind, pattern in PATTERNS.items():
        if kind in HINT and not HINT[kind].search(text):
            continue
        for m in pattern.finditer(text):
            if kind == "name":
                for a, b, role, gender in names(m["title"], m["name"]):
                    if not people.get(word := m["name"][a:b], ("", ""))[1]:  # the first role, and the first gender that is told
                        people[word] = people.get(word, (role,))[0], gender
                    take(m.start("name") + a, m.start("name") + b, "name", role, gender)
            elif valid(kind, m[0]):
                take(*m.span(), kind)
    if people:  # other mentions of the same people
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, people), key=len, reverse=True))})(?!\w)", text):
            take(*m.span(), "name", *people[m[0]])
    told = lambda a, b, role, gender: gender_of(text[a:b], gender or people[text[a:b]][1]) if role == "given" else ""
    return sorted((a, b, kind, role, told(a, b, role, gender)) for a, b, kind, role, gender in out)


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity share."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if text.startswith("+") else "") + plain(text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    return text.lower() if kind == "email" or kind == "secret" and not LEAD.match(text) else text


def replaced(text: str, made: Surrogates) -> list[tuple[int, int, str, str, str, str]]:
    """Start, end, kind, what stands for it, and what tells the old and the new entity apart from others (for names, role and gender too)."""
    out = []
    for a, b, kind, role, gender in found(text):
        new = made.of(kind, text[a:b], role, gender)
        who = f"{role}/{gender}/" if kind == "name" else ""
        out.append((a, b, kind, new, who + canonical(kind, text[a:b]), f"{role}/" * bool(role) + canonical(kind, new)))
    return out


def rewritten(text: str, made: Surrogates) -> tuple[str, list[tuple[str, int, int]], int, int]:
    """New text; kind and span of each entity in the old text; distinct entities; clashes."""
    spans = replaced(text, made)
    if not spans:
        return text, [], 0, 0
    out, at, there, back, clashes = [], 0, {}, {}, 0
    for a, b, kind, new, old_key, new_key in spans:
        old, now = (kind, old_key), (kind, new_key)
        clashes += there.setdefault(old, now) != now or back.setdefault(now, old) != old or text[a:b] == new
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [(k, a, b) for a, b, k, *_ in spans], len(there), clashes


def clashes(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, surrogate, n: surrogates that stand for several entities of the corpus; there should be none. Pairs are made distinct in each batch and before the shuffle."""
    prepare(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("old", pa.string()), ("surrogate", pa.string())])

    def run(it):
        made = Surrogates(key)
        for batch in it:
            pairs = sorted({(k, o, n) for t in batch.column(0).to_pylist() if t for _, _, k, _, o, n in replaced(t, made)})
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(3)], schema=schema)

    pairs = docs.selectExpr("cast(text as string) text").mapInArrow(run, "kind string, old string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


SPANS = "array<struct<kind: string, start: int, end: int>>"


def replace(docs: DataFrame, key: bytes = KEY) -> tuple[DataFrame, str]:
    """docs with text replaced, and a struct of what was found (spans in code points of the old text), under a name that no column has."""
    prepare(docs.sparkSession)
    name, place = unused("pii", docs.columns), [c.lower() for c in docs.columns].index("text")
    kind = pa.struct([("entities", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("n_distinct", pa.int64()), ("n_clashes", pa.int64())])

    def run(it):
        made = Surrogates(key)
        for batch in it:
            if not batch.num_rows:
                continue
            new, notes = [], []
            for text in batch.column(place).to_pylist():
                t, spans, n, clashes = rewritten(text or "", made)
                new.append(None if text is None else t)
                notes.append({"entities": [{"kind": k, "start": a, "end": b} for k, a, b in spans], "n_distinct": n, "n_clashes": clashes})
            cols = list(batch.columns)
            cols[place] = pa.array(new, batch.column(place).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(notes, kind)], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` struct<entities: {SPANS}, n_distinct: bigint, n_clashes: bigint>"), name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's new text, with the entities' kinds and places."""
    df, name = replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.selectExpr("doc_id", "text", f"cast(size({name}.entities) as bigint) as n_entities", f"{name}.n_distinct as n_distinct", f"{name}.n_clashes as n_clashes", f"{name}.entities as entities")
