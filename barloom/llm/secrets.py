r"""Secret scan: all rules in one pass over the bytes of whole texts, by one deterministic automaton.

Matches are leftmost, longest and non-overlapping for each rule. The automaton reports where a match ends; where it
begins is read backwards from there, and a rule's check then drops matches that are too short.

Defined cases: a null text is an empty one and holds nothing; equal rows give equal results; a null doc_id is kept;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import flat, pieces
from barloom.llm.automaton import Automaton, Backwards


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern: what the automaton finds; least: characters of group `group` that a match must have."""

    kind: str
    pattern: bytes
    least: int = 0
    group: int = 0
    fold: bool = False

    @property
    def flags(self) -> int:
        return re.IGNORECASE if self.fold else 0


BASE = (
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", rb"AKIA[A-Z0-9]+", 16),
    # single hexadecimal digits are everywhere; runs under 8 cannot pass the check, so the automaton leaves them out
    Rule("hex", rb"[0-9a-f]{8,}", 32),
)
MORE = (
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", rb"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", rb"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", rb"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0),
)
RULES = BASE + MORE


@cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Backwards], list[re.Pattern[bytes]]]:
    """Built once in each worker."""
    return (Automaton([(r.pattern, r.flags) for r in rules]), [Backwards(r.pattern, r.flags) for r in rules], [re.compile(r.pattern, r.flags) for r in rules])


def find(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text (start, rule, end) of its secrets in code points, in order."""
    automaton, backwards, regexes = compiled(rules)
    buf, offsets = flat(column)
    kind, lane, end = automaton.ends(buf, offsets)
    raw = buf.tobytes()
    points = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    order = np.lexsort((end, kind))
    whose = np.searchsorted(offsets, end, side="left") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    last = (-1, 0)
    for i in order.tolist():
        k, to = int(kind[i]), int(end[i])
        least = max(int(lane[i]), last[1]) if last[0] == k else int(lane[i])
        begin = backwards[k].start(raw, least, to)
        last = k, to
        rule = rules[k]
        if rule.least:
            start, stop = regexes[k].fullmatch(raw, begin, to).span(rule.group)
            if stop - start < rule.least:
                continue
        text = int(whose[i])
        base = points[offsets[text]]
        out[text].append((int(points[begin] - base), k, int(points[to] - base)))
    return [sorted(x) for x in out]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end) in code points, end exclusive, in order."""
    kind = docs.schema[doc_id].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            made = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in find(batch.column("text"), rules)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(item))], names=["doc_id", "secrets"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        rows, f"doc_id {kind}, secrets array<struct<kind: string, start: long, end: long>>")


