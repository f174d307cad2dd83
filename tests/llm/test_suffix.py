import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from subspark.llm import suffix_arrays, suffix_dedup


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 40))) for _ in range(30)] + [b"a" * 50, b"a" * 50]
    codes, starts = suffix_arrays.join_texts(texts)
    order, rank = suffix_arrays.suffix_array(codes)
    whole = codes.tolist()
    assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
    assert (rank[order] == np.arange(len(whole))).all()
    flags = suffix_arrays.repeats_inside(codes, starts, order, rank, 5)
    grams = Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))
    for t, s in zip(texts, starts.tolist()):
        for i in range(len(t) - 4):
            assert flags[s + i] == (grams[t[i : i + 5]] > 1)
    half, at = suffix_arrays.join_texts(texts[:15])
    order, _ = suffix_arrays.suffix_array(half)
    here = [s + i for t, s in zip(texts, starts.tolist()) for i in range(len(t) - 8)]
    have = {t[i : i + 9] for t in texts[:15] for i in range(len(t) - 8)}
    got = suffix_arrays.found_in(codes, np.array(here), half, order, 9)
    assert got.tolist() == [bytes((codes[p : p + 9] - 1).astype(np.uint8)) in have for p in here]


def slow(texts, size):
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if times[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hot, long = say(50), say(120)
    out = [say(30) + hot + say(20 + i) for i in range(30)] + [say(3) + long[i:] for i in range(0, 60, 7)]
    out += [say(60)] * 3 + [say(200), "x" * 700, "xy" * 300, "", None, "short", hot[:199], hot[:200], hot[1:201]]
    out += [say(40) + hot[k : k + 190] + say(40) for k in range(5)]
    once = say(80)
    return [*out, once + once]


@pytest.mark.parametrize("shard, run", [(1_000_000, 1 << 16), (3_000, 40)])
def test_same_as_brute_force(spark, monkeypatch, shard, run):
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "PART", shard)
    texts = [*passages(), "z" * 150_000, "long " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id " * 50), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(r[0], *x) for r, x in zip(rows, slow([t for _, t in rows], 200))]
    assert sorted(map(tuple, suffix_dedup.op9(docs).collect()), key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    assert suffix_dedup.op9(spark.createDataFrame([], "doc_id long, text string")).collect() == []
