import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from subspark.llm import decontaminate, line_dedup, quality_rules

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def split_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


# lines


def slow_lines(rows):
    """rows: (doc_id, text). Text kept and numbers of lines, from the definition."""
    key = lambda line: lower(line.strip(BLANKS))
    holders = defaultdict(set)
    rank = lambda i: (i is not None, i or 0)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    gone = {k: max(ids, key=rank) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "dé", "x"]) for _ in range(n))
    common = [say(6) for _ in range(4)] + ["é" * 20, "é" * 19, "short line"]
    rows = []
    for i in range(60):
        lines = [say(9) for _ in range(rng.randint(0, 4))] + [rng.choice(common) for _ in range(rng.randint(0, 3))]
        lines = [rng.choice(["", "\t", " "]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", "\r", " \x0b"]) for x in lines]
        rng.shuffle(lines)
        rows.append((i * 3 - 20, "\n".join(lines)))
    rows += [(10**15, common[1]), (None, common[0]), (500, None), (501, ""), (502, "\n\n"), (7, "new text\n" + common[1]), rows[5], rows[5], (503, "x\n" * 3000 + common[0])]
    return rows


@pytest.mark.parametrize("batches", [1, 7])
def test_lines(spark, batches):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, n_lines string, K1_of_row string").repartition(3)
    got = line_dedup.drop_lines(docs, batches=batches)
    assert got.columns[:4] == docs.columns
    assert sorted(((r[0], r[4], r[5], r[1] or "") for r in got.collect()), key=str) == sorted(slow_lines(rows), key=str)
    op = sorted(map(tuple, line_dedup.op10(docs).collect()), key=str)
    assert op == sorted(((i, n, d, digest(t)) for i, n, d, t in slow_lines(rows)), key=str)


def test_lines_of_documents_with_string_ids(spark):
    rows = [(None if i is None else f"d{i:020d}" if i >= 0 else f"-{i + 500:020d}", t) for i, t in line_rows()]
    order = sorted({i for i, _ in rows if i is not None})
    numbers = [(None if i is None else order.index(i), t) for i, t in rows]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, `a.b` int").repartition(3)
    got = line_dedup.drop_lines(docs)
    assert got.columns[:3] == docs.columns
    expected = [(None if i is None else order[i], n, d, t) for i, n, d, t in slow_lines(numbers)]
    assert sorted(((r[0], r[3], r[4], r[1] or "") for r in got.collect()), key=str) == sorted(expected, key=str)


def test_runs_take_batches_one_by_one(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for ids, keys in (([9], [1, 2]), ([7, 8], [2, 3]), ([5], [1, 4]), ([2], [4])):
        rows = [(i, k, -k) for i in ids for k in keys]
        runs.add(spark.createDataFrame(rows, "id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    got = {r.h1: (r.n_docs, r.keeper) for r in runs.all_keys().collect()}
    assert got == {1: (2, 9), 2: (3, 9), 3: (2, 8), 4: (2, 5)}
    names = list(runs.names)
    assert len(names) == 7 and all(spark.catalog.tableExists(n) for n in names)
    runs.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_batches_are_of_equal_size_wherever_ids_lie(spark):
    docs = spark.createDataFrame([(i,) for i in [*range(399), 10**15]], "doc_id long")
    rows = docs.selectExpr("doc_id AS id")
    sizes = [rows.filter(c).count() for c in line_dedup.id_ranges(docs.withColumn("number", F.col("doc_id")))]
    assert sum(sizes) == 400 and len(sizes) == 4 and max(sizes) < 110


def test_lines_of_an_empty_table(spark):
    assert line_dedup.op10(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# rules


def slow_rules(text):
    words = split_words(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    base = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    chars, symbols, dups = sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    capitals, small = (sum(a <= c <= b for c in text or "") for a, b in ("AZ", "az"))
    bad = 10 * symbols > len(words) or capitals > small or 10 * (text or "").count("!") > len(words) or 10 * dups > 3 * len(lines) or not 2 * len(words) <= chars <= 20 * len(words)
    return len(words), chars, symbols, dups, len(inside), base, not base and not bad


def test_rules(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "dé", "x", "y", "z"]) for _ in range(n))
    texts = [say(n) for n in range(0, 60, 3)] + [say(12) + "\n" + t + "\n" + t for t in (say(3), say(6))]
    texts += [None, "", "\n \n", "A B C D E F G H I J K", "## " * 30, "go! " * 12, "x" * 400 + " " + say(12), "word joined " * 9, "a b c d e " * 4000, "\x1c \x85 é" * 5]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, say(30), 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(2)
    got = quality_rules.judge(docs)
    assert got.columns[:3] == docs.columns
    assert sorted((tuple(r)[:2] + tuple(r)[3:10] for r in got.collect()), key=str) == sorted((r[:2] + slow_rules(r[1]) for r in rows), key=str)
    every = (*quality_rules.BASE, *quality_rules.RULES)
    for order in (every, every[::-1]):
        kept = [quality_rules.first_rejection(quality_rules.Page((t or "").encode()), order) is None for t in texts]
        assert kept == [slow_rules(t)[-1] for t in texts]
    lazy, (kept, by) = quality_rules.verdicts(docs)
    assert (kept, by) == ("kept_", "rejected_by") and lazy.columns == [*docs.columns, kept, by]
    assert sorted(((r.doc_id, r.text, r.kept, r[kept]) for r in lazy.collect()), key=str) == sorted(((*r, slow_rules(r[1])[-1]) for r in rows), key=str)
    assert quality_rules.op8(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_cascade_computes_only_what_it_asks_for(monkeypatch):
    """Counts how often features are computed: a document that a cheap rule rejects has no words split."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(200)).encode() for _ in range(20)]
    junk = [b"SHOUTING ABOUT %d " % k * 60 for k in range(60)]
    every = (*quality_rules.BASE, *quality_rules.RULES)
    seen = [quality_rules.measured(t, every) for t in [*good, *junk]]
    order = [every[k] for k in quality_rules.plan(seen, every)]
    assert sorted(r.name for r in order) == sorted(r.name for r in every)
    times = Counter()
    whole = quality_rules.repeat_words
    monkeypatch.setattr(quality_rules, "repeat_words", lambda w: times.update(["repeats"]) or whole(w))
    assert all(quality_rules.first_rejection(quality_rules.Page(t), order) is None for t in good)
    assert times["repeats"] == len(good)
    assert all(quality_rules.first_rejection(quality_rules.Page(t), order) for t in junk)
    assert times["repeats"] == len(good)  # none of the junk came so far
    # what is computed anyway costs nothing: rules of those counts come before others that reject as much
    same = [([1.0] * len(quality_rules.READS), [True] * len(quality_rules.RULES))]
    names = [quality_rules.RULES[k].name for k in quality_rules.plan(same, quality_rules.RULES, quality_rules.COUNTS)]
    assert names[0] in ("symbols", "lines", "word_length")


# benchmark


def slow_words(text):
    low, out, word = lower(text or ""), [], ""
    for c in low + " ":
        if ord(c) > 127 or c.isdigit() and c.isascii() or "a" <= c <= "z":
            word += c
        else:
            if word:
                out.append(word)
            word = ""
    return out


def slow_hits(text, items):
    words = slow_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        own = slow_words(item)
        n = min(10, len(own))
        for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == w:
                    hit.update(range(i, i + n))
                    found.add(item_id)
    found.discard(None)
    return len(words), len(hit), len(found), digest(",".join(sorted(map(str, found)))), bool(hit)


def benchmark_rows():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abc") + rng.choice(["", "é"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((12, 25, 10, 9, 3, 3, 1, 14, 11))] + [(20, None), (21, "--"), (None, say(12))]
    items += [(30, items[0][1] + " " + say(4)), (4, "b b b b"), (31, items[4][1])]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)]
    for k, (_, item) in enumerate(items):
        docs.append((100 + k, f"Zz, {(item or '').upper()}! zz {say(5)}"))
        docs.append((200 + k, "q " * 20 + " ".join((item or "").split()[:11])))
    return docs + [(None, items[0][1]), (400, None), (401, ""), (402, items[1][1] + " w" * 20_000), docs[0], (403, items[0][1] + "\n" + items[0][1])], items


@pytest.mark.parametrize("block, part", [(200_000, 5_000), (40, 12)])
def test_benchmark_hits(spark, monkeypatch, block, part):
    """With small blocks there are over four, and items are cut into parts."""
    monkeypatch.setattr(decontaminate.mark, "__defaults__", (decontaminate.WINDOW, block))
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    docs, items = benchmark_rows()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = [(i, *slow_hits(t, items)) for i, t in docs]
    assert sorted(map(tuple, decontaminate.op3(table, bench).collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("block", [200_000, 40])
def test_marks_beside_columns_of_the_same_names(spark, block):
    docs, items = benchmark_rows()
    names = "doc_id long, text string, n_hit string, N_WORDS string, marks string, items string, n_hit_more string, k1_of_row string, bits_of_row string"
    table = spark.createDataFrame([(*r, *"abcdefg") for r in docs], names).repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked, (n_words, n_hit, _, found) = decontaminate.mark(table, bench, block_words=block)
    assert marked.columns[:9] == table.columns
    got = sorted(((r.doc_id, r[n_words], r[n_hit], len(r[found]), r.n_hit, r.bits_of_row) for r in marked.collect()), key=str)
    assert got == sorted(((i, *slow_hits(t, items)[:3], "a", "g") for i, t in docs), key=str)


def test_many_items_share_a_passage(spark):
    """100,000 items in six blocks: the time doesn't grow with the square of their number."""
    passage = " ".join(f"w{k}" for k in range(10))
    bench = spark.range(100_000).selectExpr("id AS item_id", f"concat('{passage} own', id) AS text")
    docs = spark.createDataFrame([(1, f"so {passage} own77 it goes"), (2, passage), (3, passage[:-1])], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.op3(docs, bench).collect()}
    assert got == {1: (14, 11, 100_000), 2: (10, 10, 100_000), 3: (10, 0, 0)}


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Mine before it, {item.title()}! And after it; more words stand here than in the passage, for sure.", "k"), (2, item, "k"), (3, "clean text", None), (4, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[3].text == "clean text" and got[4].text is None
    assert got[1].text == "Mine before it, ! And after it; more words stand here than in the passage, for sure." and got[1].marks == "k"


def test_empty_benchmark_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.op3(docs, none).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.op3(docs.limit(0), none).collect() == []
