"""URL filter: fixed host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds the vocabulary's terms in the lower-cased URL; a hit counts only if no
ASCII letter or digit stands on either side. A strict term weighs as much as the limit, a soft term a part of
it; the weights of the different terms that are hit are added, so one strict or two soft terms reject.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import chunks

# fixed values: rules, in the order of the list that defines them
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
STRICT = ("porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirls", "casino", "viagra", "cialis", "spam-farm", "cheap-pills", "warez", "escorts", "sexcam", "malware", "phishing")
SOFT = ("adult", "sex", "sexy", "nude", "naked", "erotic", "fetish", "dating", "girls", "betting", "bet", "poker", "slots", "jackpot", "pills", "pharmacy", "drugs", "cheap", "free", "bonus", "loan", "loans", "payday", "crack", "keygen", "torrent", "replica", "win", "prize", "spam", "farm", "hot", "live", "cams")
LIMIT = 1.0
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SOFT_WEIGHT = 0.5


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT

    def weights(self) -> dict[str, float]:
        return {x: SOFT_WEIGHT for x in self.soft} | {x: LIMIT for x in self.strict}


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): what stands after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """(verdict, rule) of the longest rule for the host or a domain above it whose path starts the path."""
    best = (None, None)
    labels = host.split(".")
    for i in range(len(labels)):
        for start, verdict, rule in rules.get(".".join(labels[i:]), ()):
            if path.startswith(start) and (best[1] is None or len(rule) > len(best[1])):
                best = (verdict, rule)
    return best


def _by_host(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, verdict, rule))
    return out


class Terms:
    """The automaton of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.weight = vocabulary.weights()
        self.automaton = ahocorasick.Automaton()
        for term in self.weight:
            self.automaton.add_word(term, term)
        if self.weight:
            self.automaton.make_automaton()

    def hits(self, url: str) -> list[str]:
        """The different terms that stand in the URL with boundaries, in order of name."""
        text = url.lower()
        found = set()
        for end, term in self.automaton.iter(text) if self.weight else ():
            start = end - len(term) + 1
            if not (start and text[start - 1] in _ALNUM) and not (end + 1 < len(text) and text[end + 1] in _ALNUM):
                found.add(term)
        return sorted(found)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """For each row: its id, host, path, rule (the longest that fits, else null), verdict (allow or block:
    the rule's, else by the vocabulary), terms (the different terms hit, comma-joined) and weight.

    A null url, or one without ://, has an empty host and path and fits no rule; the vocabulary still
    judges its text (null: allow). Rows are judged one by one.
    """
    words = vocabulary or Vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, by_host = Terms(words), _by_host(rules)
        for b in chunks(batches, "url"):
            rows = []
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                verdict, rule = rule_of(host, path, by_host)
                hits = terms.hits(url or "")
                weight = sum(terms.weight[x] for x in hits)
                rows.append((host, path, rule, verdict or ("block" if weight >= LIMIT else "allow"), ",".join(hits), weight))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.string()) for x in columns[:5]), pa.array(columns[5], pa.float64())], names=["id", "host", "path", "rule", "verdict", "terms", "weight"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url").mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, terms string, weight double").withColumnRenamed("id", id_col)
