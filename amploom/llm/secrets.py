"""Secret scans by a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that every match must contain. For each block of
documents the index holds, for every trigram that some query names, the set of documents with it; queries
intersect and unite these postings, and only the candidates are verified with the regex. A rule whose regex
promises no trigram scans every document.

Matching is on code points of the whole text. Per rule, matches are taken leftmost and without overlap; a match
whose value is too short is dropped afterwards, so it still uses up its characters.

Nulls and odd rows: a null text counts as empty; doc_id may be null or repeated, each row gives one row; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lowered, text_slices

_MOST = 40  # strings that a run of literals may stand for before the run is closed


@dataclass(frozen=True)
class Rule:
    """A kind, its regex, the group whose length counts (0: the match) and the least length. ``case``: letters match in one case only."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    case: bool = True

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (0 if self.case else re.IGNORECASE))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, case=False),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of issued credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)


def _all(parts):
    """The conjunction of queries; True is the query that every document answers."""
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts):
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(s: str):
    b = s.encode()
    return _all([b[i : i + 3] for i in range(len(b) - 2)])


def _of_strings(strings: set[str]):
    return _any([_of_string(s) for s in sorted(strings)])


def trigram_query(pattern: str):
    """A Boolean query over lower-case trigrams that holds for every text with a match: bytes, ("and", ...), ("or", ...) or True."""
    exact, query = _sequence(_parser.parse(pattern))
    return _all([_of_strings(exact), query]) if exact is not None else query


def _sequence(items):
    run: set[str] = {""}
    asked: list = []
    whole = True
    for op, arg in items:
        exact, query = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = {a + b for a in run for b in exact}
            continue
        whole = False
        asked += [_of_strings(run), query]
        run = exact if exact is not None else {""}
    return (run, True) if whole else (None, _all([*asked, _of_strings(run)]))


def _node(op, arg):
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.AT:
        return {""}, True
    if op is sre.IN:
        chars = {chr(v).lower() for k, v in arg if k is sre.LITERAL}
        return (chars, True) if len(chars) <= 8 and all(k is sre.LITERAL for k, _ in arg) else (None, True)
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= _MOST:
            return set().union(*(e for e, _ in parts)), True
        return None, _any([q if e is None else _of_strings(e) for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, True
        if least and exact is not None and len(exact) == 1 and least == most and least * len(next(iter(exact))) <= 64:
            return {next(iter(exact)) * least}, True
        return None, True if not least else query if exact is None else _of_strings(exact)
    return None, True


def _named(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(_named, query[1:]))


class TrigramIndex:
    """Postings of the trigrams that the rules' queries name, over one block of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [trigram_query(r.pattern) for r in rules]
        names = sorted(set().union(*map(_named, self.queries)))
        self.column = {t: i for i, t in enumerate(names)}
        self._code = np.zeros(1 << 24, np.uint16)
        for t, i in self.column.items():
            self._code[int.from_bytes(t, "big")] = i + 1

    def candidates(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray | None]:
        """For each rule the texts that may match, or None: all of them."""
        low = lowered(buf).astype(np.uint32)
        has = np.zeros((len(self.column), len(offs) - 1), bool)
        if len(low) >= 3:
            found = self._code[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(found)
            doc = np.searchsorted(offs, at, "right") - 1
            inside = at + 2 < offs[doc + 1]
            has[found[at[inside]] - 1, doc[inside]] = True

        def answer(q):
            if isinstance(q, bytes):
                return has[self.column[q]]
            parts = [answer(x) for x in q[1:]]
            return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)

        return [None if q is True else answer(q) for q in self.queries]


def spans_of(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>>, by start and then in the rules' order; one row per document, with or without spans."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, compiled = TrigramIndex(rules), [r.compiled() for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch):
                found: list[list] = [[] for _ in range(hi - lo)]
                texts: dict[int, str] = {}
                for k, (rule, may) in enumerate(zip(rules, index.candidates(buf, offs))):
                    for i in range(hi - lo) if may is None else np.flatnonzero(may).tolist():
                        if i not in texts:
                            texts[i] = buf[offs[i] : offs[i + 1]].tobytes().decode()
                        found[i] += [(s, k, e) for s, e in spans_of(rule, compiled[k], texts[i])]
                out = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(block, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``: counts of the base kinds, the hash of their spans, and all spans as text."""
    say = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return spans.select("doc_id", *counts, F.sha2(say(of(*(r.kind for r in BASE))), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(documents(spark, sf_dir)))


def brute(text: str | None, rules: tuple[Rule, ...] = BASE) -> list[tuple[int, int, str]]:
    """Every rule over the whole text, without an index: what tests compare with."""
    return [(s, e, r.kind) for r in rules for s, e in spans_of(r, r.compiled(), text or "")]


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}
