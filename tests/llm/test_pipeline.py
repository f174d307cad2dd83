import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from subspark.llm import pieces, simhash
from tests.llm.test_lines_rules_benchmark import slow_hits, slow_lines, slow_rules, slow_words
from tests.llm.test_simhash import slow_components

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    shared = [say(9) for _ in range(3)]
    items = [(i, say(20)) for i in range(6)]
    rows = []
    for i in range(40):
        lines = [say(rng.randint(15, 60)) for _ in range(3)]
        if i % 4 == 0:
            lines.insert(1, rng.choice(shared))
        if i % 10 == 3:
            lines.insert(rng.randint(0, 3), f"It said {items[i % 6][1]}")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200 + i, rows[i][1].replace(".", ", too.", 1)) for i in range(10, 20)]
    rows += [(300, items[0][1] + " Yes."), (301, "JUNK!! " * 30), (302, "too short"), (303, None), (304, ""), (None, say(50)), rows[7]]
    docs = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def slow_cut(text, items):
    """Text without the words of hit spans and what stands between them; None if over half is hit."""
    n, hit, *_ = slow_hits(text, items)
    if not hit:
        return text
    if hit > n / 2:
        return None
    own = slow_words(text)
    marked = [False] * n
    for _, item in items:
        it = slow_words(item)
        grams = {tuple(it[i : i + 10]) for i in range(len(it) - 9)}
        for i in range(n - 9):
            if tuple(own[i : i + 10]) in grams:
                marked[i : i + 10] = [True] * 10
    out, at, k = "", 0, -1
    inside = lambda c: c.isalnum() and c.isascii() or ord(c) > 127
    before = False
    owner = []
    for c in text:
        if inside(c) and not before:
            k += 1
        before = inside(c)
        owner.append(k if before else None)
    for at, c in enumerate(text):
        if owner[at] is not None:
            gone = marked[owner[at]]
        else:
            left = next((owner[j] for j in range(at, -1, -1) if owner[j] is not None), None)
            right = next((owner[j] for j in range(at, len(text)) if owner[j] is not None), None)
            gone = left is not None and right is not None and marked[left] and marked[right]
        out += "" if gone else c
    return out


def test_each_stage(spark, sf_dir):
    path, rows, items = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    now = rows
    named = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near copies", "decontamination", "packing"]

    def step(name, expected):
        nonlocal docs
        docs = named[name](spark, docs, path)
        docs.write.parquet(f"{path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{path}/{name.replace(' ', '_')}")
        assert docs.columns == columns
        got = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=str)
        assert got == sorted(((i, t, len(t)) for i, t in expected), key=str), name
        return expected

    now = step("quality rules", [r for r in now if slow_rules(r[1])[-1]])
    assert 50 < len(now) < len(rows)
    now = step("line dedup", [(i, t) for i, _, _, t in slow_lines(now)])
    prints = [np.frombuffer(simhash.fingerprint(t.encode(), 5, simhash.WORDS), np.uint32) for _, t in now]
    near = lambda a, b: (x := np.bitwise_count(a ^ b)).min() <= 3 and x.sum() <= simhash.MOST
    label = slow_components(len(now), [(a, b) for a, b in combinations(range(len(now)), 2) if near(prints[a], prints[b])])
    best = {k: min((now[m] for m in range(len(now)) if label[m] == k), key=lambda r: (r[0] is None, r[0])) for k in set(label)}
    now = step("near copies", list(best.values()))
    assert {i for i, _ in now} >= {10, 11, 12, None} and not {i for i, _ in now} & set(range(200, 220))
    cut = [(i, slow_cut(t, items)) for i, t in now]
    assert any(t is None for _, t in cut) and any(t not in (None, o) for (_, t), (_, o) in zip(cut, now))
    now = step("decontamination", [r for r in cut if r[1] is not None])
    library = Tokenizer.from_file(pieces.default_path())
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in now}
    packed = named["packing"](spark, docs, path).collect()
    assert sum(r.length for r in packed) == sum(map(len, ids.values()))
    for r in packed:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    again = pipeline.run(spark, path).collect()
    assert {(r.doc_id, r.doc_tokens) for r in again} == {(r.doc_id, r.doc_tokens) for r in packed}


def test_stages_take_empty_tables(spark, sf_dir):
    path = sf_dir[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_quality_rules_with_a_column_kept(spark, sf_dir):
    path = sf_dir[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    expected = ids(pipeline.keep_good(spark, docs, path))
    for name in ("kept", "Kept"):
        clash = docs.selectExpr("*", f"doc_id = 301 AS {name}")
        got = pipeline.keep_good(spark, clash, path)
        assert got.columns == clash.columns and ids(got) == expected and 301 not in expected


def test_stages_carry_columns_with_dots_and_names_of_helpers(spark, sf_dir):
    path = sf_dir[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = {"a.b": 1, "k1_of_row": 2, "n_words": 3, "marks": 4, "number": 5, "C0": 6, "times_of_row": 7, "dropped_of_row": 8}
    wide = docs.select("*", *[F.lit(v).alias(k) for k, v in more.items()])
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, wide, path)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert all(r[k] == v for r in rows for k, v in more.items())
        plain = stage(spark, docs, path)
        assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((r.doc_id, r.text) for r in plain.collect()), key=str), name
    assert pipeline.pack(spark, wide, path).count() == pipeline.pack(spark, docs, path).count()


def test_stages_take_texts_that_are_all_null(spark, sf_dir):
    path = sf_dir[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(5).withColumn("text", F.lit(None).cast("string"))
    named = dict(pipeline.STAGES)
    assert named["quality rules"](spark, docs, path).collect() == []
    assert [r.text for r in named["line dedup"](spark, docs, path).collect()] == [None] * 5
    assert len(named["near copies"](spark, docs, path).collect()) == 1
    assert [r.text for r in named["decontamination"](spark, docs, path).collect()] == [None] * 5
    assert sum(r.length for r in named["packing"](spark, docs, path).collect()) == 5
