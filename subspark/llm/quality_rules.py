"""Quality rules as a short-circuit cascade.

A document meets the rules one by one, and the first rule that rejects it ends the cascade. Rules read
features of the text (its words, repeated words, lines, counts of signs), which are computed when first
asked for: what an early rule rejects never has the costly ones computed. The base check is one of the
rules, in two parts: too few words, and too many repeated ones.

The order is planned on a bounded sample: up to `PLAN_ROWS` documents of `PLAN_PARTS` partitions spread
over the table, picked by hash. It gives the time of each feature and which rules reject which document.
The next rule is always the one with the most rejections, among sampled documents that no earlier rule
rejects, for the time of the features that no earlier rule has computed. The order changes only the time
taken: a document is kept when no rule rejects it, in whatever order.

`verdicts` computes no more than the cascade asks for. `judge` also returns the five base counts of every
document, as its callers need them; the base check then comes first and costs nothing, and the plan
leaves documents that fail it out.

Nulls: a null text has no words and fails the base check. Repeated rows each get the same verdict. An
empty table gives no rows. Very long texts are read whole. Extra columns are carried along; new columns
get names that documents don't have.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import lit
from pyspark.sql.types import StructType, _parse_datatype_string

from subspark.llm.common import arrow_schema, binary_texts, fresh, map_carried

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: Documents that the cascade's order is planned on, the partitions they come from, and one of how many is picked.
PLAN_ROWS, PLAN_PARTS, PICK = 512, 16, 4
_BLANK = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Page:
    """One text; each feature is computed when a rule first asks for it."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.text, np.uint8)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points that aren't white space."""
        starts = int(np.count_nonzero((self.codes & 0xC0) != 0x80))
        return starts - sum(self.text.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(bytes([b])) for b in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if line.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def n_capitals(self) -> int:
        return int(np.count_nonzero((self.codes >= 65) & (self.codes <= 90)))

    @cached_property
    def n_small(self) -> int:
        return int(np.count_nonzero((self.codes >= 97) & (self.codes <= 122)))

    @cached_property
    def n_bangs(self) -> int:
        return self.text.count(b"!")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    m = n - WINDOW + 1
    with np.errstate(over="ignore"):
        mixed = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            mixed = (mixed ^ codes[k : k + m].astype(np.uint64)) * _ODD
            mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    # Equal mixes are compared word by word, so that a collision can't count.
    near = np.zeros(m, bool)
    near[order[1:][same]] = near[order[:-1][same]] = True
    at = np.flatnonzero(near)
    windows = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[at]
    _, back, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[times[back.ravel()] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


#: Features that rules name, and what each reads besides the text.
READS = {
    "words": (), "codes": (), "n_words": ("words",), "word_chars": ("codes",), "n_symbols": (), "lines": (), "n_dup_lines": ("lines",),
    "n_repeat_words": ("words",), "n_capitals": ("codes",), "n_small": ("codes",), "n_bangs": (),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    features: tuple[str, ...]
    rejects: Callable[[Page], bool]

    def needs(self) -> set[str]:
        return _with_reads(self.features)


def _with_reads(features: Iterable[str]) -> set[str]:
    return set(features).union(*(_with_reads(READS[f]) for f in features))


BASE = (
    Rule("base: words", ("n_words",), lambda p: p.n_words < MIN_WORDS),
    Rule("base: repeats", ("n_words", "n_repeat_words"), lambda p: 100 * p.n_repeat_words > MAX_REPEAT_PERCENT * p.n_words),
)
#: Each rejects a kind of junk: symbol noise, shouting, repeated lines, and strings that aren't words.
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda p: 10 * p.n_symbols > p.n_words),
    Rule("capitals", ("n_capitals", "n_small"), lambda p: p.n_capitals > p.n_small),
    Rule("bangs", ("n_bangs", "n_words"), lambda p: 10 * p.n_bangs > p.n_words),
    Rule("lines", ("n_dup_lines", "lines"), lambda p: 10 * p.n_dup_lines > 3 * len(p.lines)),
    Rule("word_length", ("n_words", "word_chars"), lambda p: not 2 * p.n_words <= p.word_chars <= 20 * p.n_words),
)


def first_rejection(page: Page, rules: Iterable[Rule]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(page)), None)


def measured(text: bytes, rules: tuple[Rule, ...]) -> tuple[list[float], list[bool]]:
    """Seconds of each feature of READS, what it reads computed before, and each rule's verdict."""
    page, took = Page(text), []
    for name in READS:  # features stand behind those that they read
        began = time.perf_counter()
        getattr(page, name)
        took.append(time.perf_counter() - began)
    return took, [bool(rule.rejects(page)) for rule in rules]


def sample(docs: DataFrame, rules: tuple[Rule, ...], rows: int = PLAN_ROWS) -> list[tuple[list[float], list[bool]]]:
    """`measured` of up to `rows` documents, picked by hash in partitions spread evenly over the table."""
    texts = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(PICK)) == 0).rdd
    n = texts.getNumPartitions()
    parts = sorted({k * n // PLAN_PARTS for k in range(PLAN_PARTS)}) if n else []
    each = -(-rows // max(len(parts), 1))
    # a task takes its first rows and stops; partitions that aren't named aren't read
    return docs.sparkSession.sparkContext.runJob(texts, lambda it: [measured((r.text or "").encode(), rules) for r in islice(it, each)], parts)


def plan(seen: list[tuple[list[float], list[bool]]], rules: tuple[Rule, ...], free: Iterable[str] = ()) -> tuple[int, ...]:
    """The order of the rules, by new rejections per second of new features; `free`: features computed anyway."""
    rejected = np.array([r for _, r in seen], bool).reshape(len(seen), len(rules))
    cost = dict(zip(READS, np.array([t for t, _ in seen]).reshape(len(seen), len(READS)).mean(0), strict=True)) if seen else dict.fromkeys(READS, 0.0)
    have, left, order = _with_reads(free), np.ones(len(seen), bool), []
    while len(order) < len(rules):
        rest = [k for k in range(len(rules)) if k not in order]
        gain = {k: (rejected[left, k].sum() + 0.01) / (sum(cost[f] for f in rules[k].needs() - have) + 1e-9) for k in rest}
        best = max(rest, key=lambda k: (gain[k], -k))
        order.append(best)
        have |= rules[best].needs()
        left &= ~rejected[:, best]
    return tuple(order)


def planned(docs: DataFrame, rules: tuple[Rule, ...], counts: bool) -> tuple[Rule, ...]:
    """The cascade: rules in order, the base check among them, or at its beginning where `counts` are wanted."""
    every = (*BASE, *rules)
    seen = sample(docs, every)
    if not counts:
        return tuple(every[k] for k in plan(seen, every))
    n = len(BASE)
    passed = [(took, rejected[n:]) for took, rejected in seen if not any(rejected[:n])]
    return (*BASE, *(rules[k] for k in plan(passed, rules, COUNTS)))


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "rejected_by": "string",
}


def _judged(docs: DataFrame, rules: tuple[Rule, ...], counts: bool) -> tuple[DataFrame, list[str]]:
    wanted = list(COLUMNS) if counts else ["kept", "rejected_by"]
    names = []
    for name in wanted:
        names.append(fresh(docs.select(*[lit(1).alias(c) for c in [*docs.columns, *names]]), name))
    cascade = planned(docs, rules, counts)
    base = {rule.name for rule in BASE}
    added = ", ".join(f"`{name}` {COLUMNS[kind]}" for name, kind in zip(names, wanted, strict=True))
    tail = arrow_schema(added)
    schema = StructType([*docs.schema.fields, *_parse_datatype_string(added).fields])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            rows = []
            for text in binary_texts(batch.column(at)):
                page = Page(text)
                by = first_rejection(page, cascade)
                rows.append((*(getattr(page, c) for c in COUNTS), by in base, by is None, by) if counts else (by is None, by))
            new = [pa.array([r[k] for r in rows], tail.field(k).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return map_carried(docs, run, schema), names


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its columns, then the base counts, base_failed, kept and rejected_by (null when kept)."""
    return _judged(docs, rules, True)[0]


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, list[str]]:
    """docs with its columns, then kept and rejected_by, and the names of these two. Of several rules that would
    reject a document, rejected_by has the one that the cascade came to first."""
    return _judged(docs, rules, False)


def op8(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).drop("text")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 4], ' ') AS gram FROM
  (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM w WHERE len(ws) >= 5)),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g),
r AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) WHERE times > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^a-z]', '', 'g')) AS small,
  length(regexp_replace(text, '[^!]', '', 'g')) AS bangs, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR capitals > small OR 10 * bangs > n_words
  OR 10 * n_dup_lines > 3 * len(full_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM b
"""
