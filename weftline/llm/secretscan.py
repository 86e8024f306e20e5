"""Secrets in texts, by one automaton for all rules.

All rules are compiled into one minimal automaton that reads a text once, from its
end, and marks at each byte the rules of which a match begins there. From left to
right the first mark at or after the end of a rule's last match then begins its
next one, and the rule's own automaton, run over the match alone, finds where the
longest one ends. So matches are the leftmost ones, longest, and of one rule do
not overlap. Marks are kept as runs, so a long run of digits costs one entry.

The work is a map over documents: no shuffle, and a task holds one batch of texts.
The automata are compiled on the driver (some hundred states) and shipped with the
task.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import Automaton
from .common import prepare


class Rule(NamedTuple):
    """Matches of head and value. Those whose value has fewer than ``least`` bytes
    are dropped after they were matched. Where a head may end must not depend on the
    value: the value begins where the longest match of the head ends."""

    kind: str
    head: str
    value: str
    least: int = 0


#: The rules that are always there: fixed values. A run of 16 or more hexadecimal
#: digits is looked for as such: shorter runs, of which a text is full, then leave no mark.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", "", r"[0-9a-f]{16,}", 16),
]
#: Public formats of keys and tokens with a form of their own.
MORE = [
    Rule("private_key", "", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 20),
    Rule("stripe", r"[rs]k_live_", r"[A-Za-z0-9]+", 24),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
    Rule("bearer", r"(?i:authorization: bearer )", r"[A-Za-z0-9+/_.=~-]+", 20),
]
RULES = BASE + MORE

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Scanner:
    def __init__(self, rules: list[Rule]):
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("a kind has one rule")
        whole = [f"(?:{r.head})(?:{r.value})" for r in rules]
        self.rules = rules
        self.begins = Automaton(whole, backward=True, anywhere=True)
        self.ends = [Automaton([p]) for p in whole]
        self.heads = [Automaton([r.head]) if r.head else None for r in rules]

    def marks(self, data: bytes) -> list[list[tuple[int, int]]]:
        """For each rule the runs (first, last) of bytes at which a match begins, in order."""
        auto = self.begins
        table, accepting, s = auto.table, auto.accepting, auto.start
        hits, last = [], None  # [state, k of its first hit, k of its last] of hits in a row, k from the end
        for k, c in enumerate(data.translate(auto.classes)[::-1]):
            s = table[s + c]
            if s >= accepting:
                if last and last[0] == s and last[2] == k - 1:
                    last[2] = k
                else:
                    last = [s, k, k]
                    hits.append(last)
        end, found = len(data) - 1, [[] for _ in self.rules]
        for state, first, late in reversed(hits):
            bits = auto.accepts[state]
            for r, runs in enumerate(found):
                if bits >> r & 1:
                    runs.append((end - late, end - first))
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) in code points, in order."""
        data = text.encode("utf-8", "surrogatepass")
        out = []
        for r, runs in enumerate(self.marks(data)):
            if not runs:
                continue
            rule, ends, head, at = self.rules[r], self.ends[r], self.heads[r], 0
            seen, headed = data.translate(ends.classes), head and data.translate(head.classes)
            for first, last in runs:
                while max(first, at) <= last:
                    first = max(first, at)
                    at = ends.longest(seen, first)
                    if at - (head.longest(headed, first) if head else first) >= rule.least:
                        out.append((first, r, at))
        out.sort()
        if len(data) == len(text):
            return out
        points, byte, n = {}, 0, 0
        for b in sorted({x for a, _, z in out for x in (a, z)}):
            n += len(data[byte:b].decode("utf-8", "surrogatepass"))
            byte, points[b] = b, n
        return [(points[a], r, points[z]) for a, r, z in out]


def spans_of(text: Column, rules: list[Rule]) -> Column:
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": kinds[r], "start": a, "end": z} for a, r, z in scanner.spans(t)] if t else [])

    return run(text)


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end), code points, end not
    included, by start and then by the order of the rules. rules: BASE and MORE if
    none are given; spans of different kinds may overlap.

    A null or empty text has no spans (an empty array). Very long texts are scanned
    whole; equal rows give equal rows; nulls in other columns pass through. An input
    column of the name spans, in any case, is replaced. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"]
    return docs.select(*rest, spans_of(F.col(text_col).cast("string"), RULES if rules is None else rules).alias("spans"))


def redacted(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced by the kind of the first of
    them in brackets; spans that overlap or touch are replaced as one. Null stays null."""
    found = find_secrets(docs, rules, text_col)

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, found):
            out, at, open_to = [], 0, -1
            for s in found:
                if s["start"] > open_to:
                    out += [t[at:s["start"]], f"[{s['kind']}]"]
                at = open_to = max(open_to, s["end"])
            return "".join(out) + t[at:]

        return pd.Series([t if t is None else one(t, s) for t, s in zip(texts, spans)], dtype=object)

    cast = F.col(text_col).cast("string")
    rest = [run(cast, F.col("spans")).alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in found.columns if c != "spans"]
    return found.select(*rest)


def written_out(kinds: list[str] | None = None) -> Column:
    """The spans, or those of some kinds, as kind:start:end, joined by commas."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
