"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton over the lower-cased url finds the terms; an occurrence counts if
no ASCII letter or digit touches it on either side. A strict term weighs as much as the
threshold, a soft one less, and each distinct term counts once: one strict or several distinct
soft terms reach the threshold and block the url.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits
an empty host, and a null url has no terms, so it is allowed; rules of equal length: the one
with the longer host wins; every row gives one row, repeats and ties included; other columns
are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from symgrain.llm.common import trimmed

THRESHOLD = 1.0
#: Words that alone mark a url, and words of which two are needed.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "milf", "gangbang", "viagra", "cialis", "onlinecasino", "warez", "keygen")
SOFT = ("adult", "sex", "sexy", "nude", "erotic", "escort", "dating", "casino", "poker", "betting", "slots", "jackpot", "pills", "pharmacy", "payday", "loans", "torrent", "crack", "nulled", "replica")
VOCABULARY = {t: THRESHOLD for t in STRICT} | {t: THRESHOLD / 2 for t in SOFT}
#: The rules travel with each task, so their number is bounded.
MAX_RULES = 500_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
_TO_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    found = _PARTS.match(rest)
    return found[1].translate(_TO_LOWER), found[2]


class UrlJudge:
    def __init__(self, rules: tuple[Rule, ...], vocabulary: dict[str, float], threshold: float):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can go with each task")
        self.rules: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.rules.setdefault(rule.host, []).append(rule)
        self.vocabulary, self.threshold, self.terms = vocabulary, threshold, ahocorasick.Automaton()
        for term in vocabulary:
            self.terms.add_word(term, term)
        if vocabulary:
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        best = None
        while host:
            for rule in self.rules.get(host, ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
            host = host.partition(".")[2]
        return best

    def found(self, url: str | None) -> set[str]:
        text = (url or "").translate(_TO_LOWER)
        if not text or not self.vocabulary:
            return set()
        touches = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
        return {term for end, term in self.terms.iter(text) if not touches(end + 1) and not touches(end - len(term))}

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, float]:
        host, path = host_and_path(url)
        weight = sum(self.vocabulary[t] for t in self.found(url))
        rule = self.rule(host, path)
        return host, path, rule and rule.text, rule.verdict if rule else "block" if weight >= self.threshold else "allow", weight


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = (), vocabulary: dict[str, float] | None = None, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, weight) of each row."""
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    UrlJudge(tuple(rules), vocabulary, threshold)

    @trimmed
    def run(batches):
        judge = UrlJudge(tuple(rules), vocabulary, threshold)
        for batch in batches:
            each = list(zip(*map(judge.judge, batch.column(1).to_pylist()), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in each[:4]), pa.array(each[4], pa.float64())], [id_col, "host", "path", "rule", "verdict", "weight"])

    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string, weight double")
