"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark's items are the index: each item's words extend one automaton. Document words stream
through it; the longest match that ends at each word shows whether a window of `window` item words, or
a whole shorter item, ends there. Items are cut into parts of at most `PART_WORDS` words that overlap
by window - 1, so that each window stands whole in a part, and parts are dealt out over blocks of about
`BLOCK_WORDS` words. Tasks build the automata, one for each block, and write them to the shared folder.
Documents meet the blocks one after another, and what is hit is written before the next block's
automaton takes the place of the last one: one automaton is on the driver, broadcast and in a worker's
memory at a time, however large the benchmark is. With a single block nothing is written in between.

Nulls: a null text has no words; a null item_id marks words but isn't counted or listed. Items without
words are ignored. Rows that repeat an item_id count as one item; repeated documents each get a row. A
benchmark without rows hits nothing, and documents without rows give none. Very long texts are scanned
whole, a text at a time. Extra columns of documents stay; new ones get names that documents don't have.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from subspark.llm.common import binary_texts, doc_key, fresh, map_carried, stored

WINDOW = 10
#: Words of items in one automaton; about 400 bytes a word when broadcast.
BLOCK_WORDS = 200_000
#: Most words of an item that stay together.
PART_WORDS = 5_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z become a-z; what can't be in a word becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def spans_of(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of each word in the text as it is."""
    return [m.span() for m in _WORD.finditer(text.translate(_TABLE))]


@dataclass
class Automaton:
    """Suffix automaton of several word sequences."""

    window: int = WINDOW
    vocab: dict[bytes, int] = field(default_factory=dict)
    nexts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    #: For a state of at least `window` words: the state that holds its last `window` words.
    level: list[int] = field(default_factory=list)
    #: Items that have the window of such a state; whole items under a window's size that end at a state.
    holders: dict[int, set] = field(default_factory=dict)
    short: dict[int, tuple[int, set]] = field(default_factory=dict)
    #: The nearest state on the way of links, itself included, where a short item ends.
    short_up: list[int] = field(default_factory=list)
    least: int = WINDOW

    def _extend(self, last: int, code: int) -> int:
        nexts, link, size = self.nexts, self.link, self.size
        if code in nexts[last]:
            at = nexts[last][code]
            return at if size[at] == size[last] + 1 else self._split(last, at, code)
        new = len(size)
        nexts.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at != -1 and code not in nexts[at]:
            nexts[at][code] = new
            at = link[at]
        if at != -1:
            other = nexts[at][code]
            link[new] = other if size[other] == size[at] + 1 else self._split(at, other, code)
        return new

    def _split(self, at: int, other: int, code: int) -> int:
        copy = len(self.size)
        self.nexts.append(dict(self.nexts[other]))
        self.link.append(self.link[other])
        self.size.append(self.size[at] + 1)
        self.link[other] = copy
        while at != -1 and self.nexts[at].get(code) == other:
            self.nexts[at][code] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes]) -> list[int]:
        codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
        last = 0
        for code in codes:
            last = self._extend(last, code)
        return codes

    def finish(self, items: list[tuple[str | None, list[int]]]) -> None:
        """After all items are added: which of them have which windows."""
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.level = [-1] * len(self.size)
        for s in order:
            if self.size[s] >= self.window:
                self.level[s] = s if self.size[self.link[s]] < self.window else self.level[self.link[s]]
        for name, codes in items:
            state = 0
            for k, code in enumerate(codes):
                state = self.nexts[state][code]
                if k + 1 >= self.window:
                    self.holders.setdefault(self.level[state], set()).add(name)
            if 0 < len(codes) < self.window:
                # the state of the whole item holds no longer string that starts elsewhere in its last words
                self.short.setdefault(state, (len(codes), set()))[1].add(name)
                self.least = min(self.least, len(codes))
        self.short_up = [-1] * len(self.size)
        for s in order:
            self.short_up[s] = s if s in self.short else self.short_up[self.link[s]]

    def scan(self, codes: list[int], mark: np.ndarray, base: int, levels: set[int], ends: set[int]) -> None:
        """Walk over known words; set hit words in mark, and add the states of windows and of short items found."""
        nexts, link, size, window = self.nexts, self.link, self.size, self.window
        state = length = 0
        for k, code in enumerate(codes):
            while state and code not in nexts[state]:
                state = link[state]
                length = size[state]
            if code in nexts[state]:
                state = nexts[state][code]
                length += 1
            if length >= window:
                mark[base + k - window + 1 : base + k + 1] = True
                levels.add(self.level[state])
            if self.short and length >= self.least:
                at = self.short_up[state]
                while at > 0:
                    n = self.short[at][0]
                    if n <= length:
                        mark[base + k - n + 1 : base + k + 1] = True
                        ends.add(at)
                    at = self.short_up[link[at]]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        n = len(words)
        mark, levels, ends = np.zeros(n, bool), set(), set()
        if n < self.least:
            return mark, set()
        codes = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start >= self.least:
                self.scan(codes[start:end].tolist(), mark, start, levels, ends)
        return mark, set().union(*(self.holders[x] for x in levels), *(self.short[x][1] for x in ends))


def build(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Automaton:
    made = Automaton(window)
    made.finish([(name, made.add(words)) for name, words in items])
    return made


def parts_of(words: list[bytes], window: int, most: int = PART_WORDS) -> list[list[bytes]]:
    """Parts of up to `most` words that have all windows of the item; a short item is one part."""
    if len(words) <= most:
        return [words] if words else []
    return [words[k : k + most] for k in range(0, len(words) - window + 1, most - window + 1)]


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """(block, made binary): a pickled automaton for each block of item parts, built in tasks."""
    longest = min(PART_WORDS, max(most, window))

    def parts(batches):
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), strict=True):
                out.extend((name, b" ".join(p), len(p)) for p in parts_of(words_of(text), window, longest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["name", "part", "n"])

    def made(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = zip(table.column("name").to_pylist(), table.column("part").to_pylist(), strict=True)
        raw = pickle.dumps(build([(name, part.split(b" ")) for name, part in rows], window), protocol=5)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "made": pa.array([raw], pa.binary())})

    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").filter(F.col("text").isNotNull())
    rows = stored(items.mapInArrow(parts, "name string, part binary, n long").distinct(), "items")
    blocks = -(-(rows.agg(F.sum("n")).first()[0] or 0) // most)
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("name", "part"), F.lit(max(blocks, 1))))
    return stored(keyed.groupBy("block").applyInArrow(made, "block long, made binary"), "automata")


FOUND = "n_words long, n_hit long, marks binary, items array<string>"


def _named(names: list[str]):
    fields = _parse_datatype_string(FOUND).fields
    for each, name in zip(fields, names, strict=True):
        each.name = name
    return fields


def _columns(n_words: list[int], marks: list[np.ndarray | None], items: list[list[str]]) -> list[pa.Array]:
    """The columns of FOUND; marks: hit words, None for none."""
    hit = [0 if m is None else int(np.count_nonzero(m)) for m in marks]
    bits = [np.packbits(m).tobytes() if n else None for m, n in zip(marks, hit, strict=True)]
    return [pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))]


def _listed(found: set) -> list[str]:
    return sorted(x for x in found if x is not None)


def _marked(docs: DataFrame, made: bytes | None, names: list[str]) -> DataFrame:
    """docs with the columns of FOUND, by the given names, of a single automaton."""
    shared = docs.sparkSession.sparkContext.broadcast(made)
    at = docs.columns.index("text")

    def run(batches):
        one = pickle.loads(shared.value) if shared.value else build([])
        for batch in batches:
            found = [(len(words), *one.hits(words)) for words in map(words_of, binary_texts(batch.column(at)))]
            n_words, marks, items = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            new = _columns(n_words, marks, [_listed(x) for x in items])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return map_carried(docs, run, StructType([*docs.schema.fields, *_named(names)]))


HITS = "k1 long, k2 long, bits binary, items array<string>"


def _block_hits(keyed: DataFrame, made: bytes) -> DataFrame:
    """keyed: (k1, k2, text). HITS of one automaton, of documents that it hits, written to the shared folder."""
    shared = keyed.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        one = pickle.loads(shared.value)
        for batch in batches:
            out = []
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_texts(batch.column(2)), strict=True):
                mark, found = one.hits(words_of(text))
                if mark.any():
                    out.append((k1, k2, np.packbits(mark).tobytes(), _listed(found)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k1", "k2", "bits", "items"])

    found = stored(keyed.mapInArrow(run, HITS), "hits")
    shared.destroy()
    return found


def _put_together(docs: DataFrame, hits: DataFrame, names: list[str]) -> DataFrame:
    """docs with the columns of FOUND from the HITS of all blocks: a row for each block that hits a document."""
    a, b = fresh(docs, "k1_of_row"), fresh(docs, "k2_of_row")
    c, d = fresh(docs, "bits_of_row"), fresh(docs, "items_of_row")
    one = hits.groupBy("k1", "k2").agg(F.collect_set("bits").alias("bits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    rows = docs.withColumns({a: k1, b: k2}).join(one.toDF(a, b, c, d), [a, b], "left")
    rows = rows.select(*[F.col(f"`{n}`") for n in docs.columns], c, d)
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            n_words = [len(words_of(t)) for t in binary_texts(batch.column(at))]
            marks = []
            for n, some in zip(n_words, batch.column(width).to_pylist(), strict=True):
                bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in some]) if some else None
                marks.append(None if bits is None else np.unpackbits(bits, count=n))
            new = _columns(n_words, marks, [sorted(x or []) for x in batch.column(width + 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*batch.schema.names[:width], *names])

    return map_carried(rows, run, StructType([*docs.schema.fields, *_named(names)]))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """docs with four more columns, whose names are returned: n_words, n_hit, hit words as bits, items found."""
    names = [fresh(docs, base) for base in ("n_words", "n_hit", "marks", "items")]
    made = automata(benchmark, window, block_words)
    blocks = sorted(r.block for r in made.select("block").collect())
    if len(blocks) < 2:
        return _marked(docs, bytes(made.first().made) if blocks else None, names), names
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text").filter(F.col("text").isNotNull())
    each = [_block_hits(keyed, bytes(made.filter(F.col("block") == k).first().made)) for k in blocks]
    return _put_together(docs, reduce(DataFrame.unionByName, each), names), names


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """docs, same columns: hit spans of over max_span words are cut out of the text, and documents of which
    over max_coverage is hit are left out. A null text stays."""
    marked, (_, _, marks, _) = mark(docs, benchmark, window)
    at, bits = marked.columns.index("text"), marked.columns.index(marks)
    width = len(docs.columns)

    def run(batches):
        for batch in batches:
            keep, texts = [], []
            for row, (text, packed) in enumerate(zip(batch.column(at), batch.column(bits), strict=True)):
                text = text.as_py()
                if packed.is_valid:
                    raw = text.encode()
                    spans = spans_of(raw)
                    hit = np.unpackbits(np.frombuffer(packed.as_py(), np.uint8), count=len(spans)).astype(bool)
                    if hit.sum() > max_coverage * len(spans):
                        continue
                    text = cut(raw, spans, hit, max_span).decode()
                keep.append(row)
                texts.append(text)
            left = batch.take(pa.array(keep, pa.int64()))
            columns = [pa.array(texts, pa.string()) if k == at else left.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return map_carried(marked, run, docs.schema)


def cut(raw: bytes, spans: list[tuple[int, int]], hit: np.ndarray, max_span: int) -> bytes:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    out, done = [], 0
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        if end - start > max_span:
            out.append(raw[done : spans[start][0]])
            done = spans[end - 1][1]
    return b"".join([*out, raw[done:]])


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    marked, (n_words, n_hit, _, items) = mark(docs.select("doc_id", "text"), benchmark)
    return marked.select(
        "doc_id",
        n_words,
        n_hit,
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (F.col(n_hit) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS gram FROM
  (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM k)),
h AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram FROM
  (SELECT doc_id, n, ws, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS p FROM d, (SELECT DISTINCT n FROM k))),
m AS (SELECT doc_id, h.n, p, item_id FROM h JOIN g ON h.n = g.n AND h.gram = g.gram),
w AS (SELECT doc_id, count(DISTINCT p + x)::BIGINT AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM
  (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
