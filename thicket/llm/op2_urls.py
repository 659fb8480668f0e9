"""URL filters: a weighted vocabulary of terms, counted by an Aho-Corasick automaton.

A term counts where neither neighbour is an ASCII letter or digit, anywhere in the url, A-Z lower-cased. One strict term rejects; so do several
distinct soft terms of enough weight together. Rules on hosts and paths go before the vocabulary: the longest that fits decides.

A null url, or one without `://`, has an empty host and path; its text, if any, is still searched, whole. A null page_id stays null; repeated rows get
repeated verdicts. Empty tables give empty tables. Columns other than page_id and url are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lines, prepare, table

NAME = "op2_weighted_url_terms"
#: Terms that reject alone, and soft terms with their weights.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "casino-win", "free-bets", "cheap-pills", "torrentz", "warez")
SOFT = {"adult": 2, "ads": 1, "bet": 1, "bets": 1, "bonus": 1, "casino": 2, "cheap": 1, "click": 1, "deal": 1, "free": 1, "jackpot": 2, "loan": 1, "pills": 2, "poker": 2, "promo": 1, "sex": 2, "slots": 2, "track": 1, "viagra": 2, "win": 1}
#: Distinct soft terms, and their weight together, from which a url is rejected.
SOFT_TERMS, SOFT_WEIGHT = 2, 2
#: (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, int], ...] = tuple(SOFT.items())
    terms: int = SOFT_TERMS
    weight: int = SOFT_WEIGHT

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in [*self.soft, *((t, 0) for t in self.strict)]:
            a.add_word(t, (t, w))
        a.make_automaton()
        return a


def parts(url: str) -> tuple[str, str]:
    """Host and path."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return lower(host), rest[:cut]


def lower(s: str) -> str:
    return s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hits(automaton: ahocorasick.Automaton, text: str) -> tuple[set[str], set[str], int]:
    """Distinct strict terms, distinct soft terms, weight of the soft ones."""
    strict, soft, weight = set(), set(), 0
    for end, (term, w) in automaton.iter(text):
        begin = end - len(term) + 1
        if (begin and text[begin - 1] in WORD) or (end + 1 < len(text) and text[end + 1] in WORD):
            continue
        if not w:
            strict.add(term)
        elif term not in soft:
            soft.add(term)
            weight += w
    return strict, soft, weight


class Rules:
    """Rules by host and path: a url costs a lookup for each label of its host and each length of path there, however many rules there are."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.of: dict[str, dict[int, dict[str, str]]] = {}
        for host, path, verdict in rules:
            self.of.setdefault(host, {}).setdefault(len(path), {})[path] = verdict

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, host and path together, and its verdict; of two as long, the later in order of their letters."""
        best = (0, None, None)
        while True:
            for n, own in self.of.get(host, {}).items():
                if (verdict := own.get(path[:n])) is not None:
                    best = max(best, (len(host) + n, host + path[:n], verdict)) if best[1] else (len(host) + n, host + path[:n], verdict)
            _, dot, host = host.partition(".")
            if not dot:
                return best[1:]


SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("n_strict", pa.int64()), ("n_soft", pa.int64()), ("soft_weight", pa.int64())])


def judge(pages: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the terms that were found."""
    prepare(pages.sparkSession)

    def run(it):
        automaton, known = vocabulary.automaton(), Rules(rules)

        def fn(batch: pa.RecordBatch) -> list:
            cols: list[list] = [[] for _ in range(7)]
            for url in batch.column("url").to_pylist():
                host, path = parts(url or "")
                strict, soft, weight = hits(automaton, lower(url or ""))
                rule, verdict = known.find(host, path)
                if verdict is None:
                    verdict = "block" if strict or (len(soft) >= vocabulary.terms and weight >= vocabulary.weight) else "allow"
                for c, v in zip(cols, (host, path, rule, verdict, len(strict), len(soft), weight), strict=True):
                    c.append(v)
            return [batch.column("page_id"), *cols]

        return lines(it, fn, SCHEMA)

    out = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, soft_weight long"
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f} THEN '{x[k]}'" for f, *x in fits) + " END"
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{up}', '{low}') AS u, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{up}', '{low}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT page_id, host, path, {" + ".join(map(found, STRICT))} AS n_strict, {" + ".join(map(found, SOFT))} AS n_soft,
    {" + ".join(f"{w} * {found(t)}" for t, w in SOFT.items())} AS soft_weight FROM a)
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)},
    CASE WHEN n_strict > 0 OR (n_soft >= {SOFT_TERMS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
    n_strict::BIGINT AS n_strict, n_soft::BIGINT AS n_soft, soft_weight::BIGINT AS soft_weight FROM b"""
