"""Source divergence audit with a baseline-correction inverted index.

Tasks count the terms of their texts by (lang, source), and the documents that hold them by lang. Terms in
at least `LEAST` documents of a lang are kept, each with its postings: the sources that have it, with
counts. The divergence of a pair of sources starts at V times the value of a term that neither has. Tasks
then walk through the postings and add, for each posting and each other source of the lang, the difference
between the term's value and that start; a term that neither source has adds nothing. A task adds up its
corrections in arrays, so that no pair leaves it more than once for each batch of terms. The terms that
stand out in a source are ranked by a window over the postings.

All sums are exact: shares are whole numbers of 10^-9, found in three steps of 1,000 so that 64 bits do for
totals of up to 9 * 10^15 words.

Nulls: a null text, lang or source is ''. Each row counts as a document, repeated ones too. Equal values are
ranked by the UTF-8 bytes of the item. An empty table gives no rows; a group without terms has its pairs
and no terms. Very long texts are split about a megabyte at a time. Extra columns aren't read.

Groups (lang, source) go to all tasks, at most about `GROUPS` at a time: where there are more, langs are
dealt into so many blocks by hash, each of which walks through its own postings. One lang's groups stay
together, and its result has the square of their number.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subspark.llm.common import LOWER, UPPER, binary_texts, stored
from subspark.llm.terms import byte_table, split

LEAST, TOP = 3, 200
#: Groups that are broadcast at a time (about 100 bytes each).
GROUPS = 200_000
#: Counts that a worker holds before it sends them on, and cells of an array of corrections.
HELD, CELLS = 600_000, 1_000_000
TABLE = byte_table(UPPER + LOWER)


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, term, source, n, docs): counts of a task's share of the texts; `docs`, the documents of the lang that hold
    the term, stands in one of the term's rows."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def out(words: dict, holders: dict):
        for (lang, source), found in words.items():
            left = holders[lang]
            names = list(found)
            for k in range(0, len(names), 20_000):
                some = names[k : k + 20_000]
                terms = pa.array(some, pa.binary()).cast(pa.string())
                rows = [pa.repeat(lang, len(some)), terms, pa.repeat(source, len(some)), pa.array([found[t] for t in some], pa.int64()), pa.array([left.pop(t, 0) for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, schema=schema)

    def run(batches):
        words, holders = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (lang, source, raw) in enumerate(zip(langs, sources, binary_texts(batch.column(2)), strict=True)):
                found, own = words[lang, source], set()
                for terms in split(raw, TABLE):
                    found.update(terms)
                    own.update(terms)
                holders[lang].update(own)
                if k % 64 == 63 and sum(map(len, words.values())) > held:
                    yield from out(words, holders)
                    words, holders = defaultdict(Counter), defaultdict(Counter)
        yield from out(words, holders)

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInArrow(run, "lang string, term string, source string, n long, docs long")


def postings(docs: DataFrame, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(lang, term, n, sources array<string>, counts array<long>) of the kept terms. Rows are dealt by (lang, term) once;
    a term has an entry for each of its sources."""
    dealt = counted(docs, held).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = by_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("p"))
    return lists.filter(F.col("docs") >= least).select("lang", "term", "n", F.col("p.source").alias("sources"), F.col("p.n").alias("counts"))


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, lang_n, v): every group with its words among kept terms, those of its lang, and the number of
    kept terms."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p"))
    sums = each.groupBy("lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("v"))
    joined = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return joined.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "v")])


def share_expr(count: str, n: str, v: str) -> str:
    """SQL text of 1 + floor(10^9 * (count + 1) / (n + v))."""
    m = f"({n} + {v})"
    first, rest = f"((({count}) + 1) * 1000 div {m})", f"((({count}) + 1) * 1000 % {m})"
    second, last = f"({rest} * 1000 div {m})", f"({rest} * 1000 % {m})"
    return f"(1 + {first} * 1000000 + {second} * 1000 + {last} * 1000 div {m})"


def shares(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    out, rest = np.zeros(np.broadcast_shapes(count.shape, np.shape(m)), np.int64), count + 1
    for _ in range(3):
        out = out * 1000 + rest * 1000 // m
        rest = rest * 1000 % m
    return out + 1


def corrections(kept: DataFrame, known: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, source, item, value): what each task's postings add to pairs of sources."""
    found: dict[str, list] = defaultdict(list)
    for r in known.collect():  # at most about GROUPS rows
        found[r.lang].append((r.source, r.n, r.v))
    shared = known.sparkSession.sparkContext.broadcast({lang: sorted(rows) for lang, rows in found.items()})
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches):
        of_lang: dict[str, tuple] = {}
        held: dict[str, np.ndarray] = {}

        def rows(lang: str, sums: np.ndarray, first: int):
            """sums[a - first, b]: what pair (a, b) gets."""
            names = of_lang[lang][0]
            a, b = np.nonzero(sums)
            for k in range(0, len(a), 50_000):
                x, y = a[k : k + 50_000], b[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(x)), names.take(pa.array(x + first)), names.take(pa.array(y)), pa.array(sums[x, y])], schema=schema)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                if lang not in of_lang:
                    entries = shared.value[lang]
                    totals = np.array([n for _, n, _ in entries], np.int64) + entries[0][2]
                    of_lang[lang] = pa.array([s for s, _, _ in entries]), {s: k for k, (s, _, _) in enumerate(entries)}, totals, shares(np.zeros(len(totals), np.int64), totals)
                names, place, totals, zero = of_lang[lang]
                size = len(totals)
                dense = size * size <= cells
                if dense and lang not in held:
                    held[lang] = np.zeros((size, size), np.int64)
                own = batch.take(pa.array([k for k, x in enumerate(langs) if x == lang]))
                lists, counts = own.column(1), own.column(2)
                ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
                sources = np.array([place[s] for s in lists.flatten().to_pylist()], np.int64)
                numbers = counts.flatten().to_numpy()
                step = max(1, cells // size)
                low = 0
                while low < len(ends) - 1:
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] + step, "right")) - 1)
                    at = slice(ends[low], ends[high])
                    for a, fwd, back in _sums(np.repeat(np.arange(high - low), np.diff(ends[low : high + 1])), sources[at], numbers[at], totals, zero, step):
                        if dense:
                            held[lang][a] += fwd
                            held[lang][:, a] += back
                        else:
                            yield from rows(lang, fwd[None, :], a)
                            yield from ((pa.RecordBatch.from_arrays([x.column(0), x.column(2), x.column(1), x.column(3)], schema=schema)) for x in rows(lang, back[None, :], a))
                    low = high
        for lang, sums in held.items():
            yield from rows(lang, sums, 0)

    return kept.select("lang", "sources", "counts").mapInArrow(run, "lang string, source string, item string, value long")


def _sums(term: np.ndarray, source: np.ndarray, count: np.ndarray, totals: np.ndarray, zero: np.ndarray, step: int):
    """For each source a of these postings: a, the corrections of pairs (a, b) for each b, and those of (b, a) from terms
    that b doesn't have."""
    p = shares(count, totals[source])
    n_terms = int(term[-1]) + 1
    for low in range(0, len(term), max(step, 1)):
        some = slice(low, low + max(step, 1))
        t = term[some]
        first = int(t[0])
        inside = (term >= first) & (term <= t[-1])
        table = np.tile(zero, (min(n_terms, int(t[-1]) + 1) - first, 1))
        has = np.zeros(table.shape, bool)
        table[term[inside] - first, source[inside]] = p[inside]
        has[term[inside] - first, source[inside]] = True
        order = np.argsort(source[some], kind="stable")
        t, a, own = t[order] - first, source[some][order], p[some][order][:, None]
        other, absent = table[t], ~has[t]
        square = (own - other) ** 2
        base = (zero[a][:, None] - zero) ** 2
        fwd = square // other - base // zero
        back = (square // own - base // zero[a][:, None]) * absent
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        for k, x, y in zip(a[starts], np.add.reduceat(fwd, starts), np.add.reduceat(back, starts), strict=True):
            x[k] = y[k] = 0
            yield int(k), x, y


def pairs(kept: DataFrame, known: DataFrame, most: int = GROUPS) -> DataFrame:
    """(lang, source, item, value) for each two sources of a lang."""
    a, b = known.alias("a"), known.alias("b")
    p, q = share_expr("0L", "a.n", "a.v"), share_expr("0L", "b.n", "b.v")
    start = F.expr(f"if(a.v = 0, 0L, a.v * (({p} - {q}) * ({p} - {q}) div {q}))")
    # the result has a row for each of these pairs
    base = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select(
        "a.lang", "a.source", F.col("b.source").alias("item"), start.alias("value")
    )
    blocks = -(-known.count() // most)
    parts = [base]
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k
        parts.append(corrections(kept.filter(mine), known.filter(mine)) if blocks > 1 else corrections(kept, known))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def standing_out(kept: DataFrame, known: DataFrame, most: int = GROUPS) -> DataFrame:
    """(lang, source, item, value) for each kept term that a source has more of than its lang."""
    each = kept.select("lang", "term", F.col("n").alias("in_lang"), F.explode(F.arrays_zip("sources", "counts")).alias("p"))
    each = each.select("lang", "term", "in_lang", F.col("p.sources").alias("source"), F.col("p.counts").alias("count"))
    joined = each.join(F.broadcast(known) if known.count() <= most else known, ["lang", "source"])
    both = joined.select("lang", "source", F.col("term").alias("item"), F.expr(share_expr("count", "n", "v")).alias("p"), F.expr(share_expr("in_lang", "lang_n", "v")).alias("q"))
    return both.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = GROUPS, held: int = HELD) -> DataFrame:
    """docs: (text, lang, source). (lang, source, part, item, value, rank)."""
    kept = stored(postings(docs, least, held), "divergence_terms")
    known = stored(groups(docs, kept), "divergence_groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs(kept, known, most).withColumn("rank", F.row_number().over(order))
    terms = standing_out(kept, known, most).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return ranked.select(*columns("pair")).unionByName(terms.select(*columns("term")))


def op12(docs: DataFrame) -> DataFrame:
    return audit(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT r, lang, source, unnest(ts) AS t FROM d),
o AS (SELECT lang, source, t, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT lang, t FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.t, coalesce(o.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
p AS (SELECT lang, source, t, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM c JOIN v USING (lang)),
l AS (SELECT lang, t, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM
  (SELECT lang, t, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b
  ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
w AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b
  ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN l USING (lang, t) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM w)
WHERE part = 'pair' OR rank <= 200
"""
