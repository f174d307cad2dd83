import random

import pytest

from subspark.llm import chunk_dedup


def say(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def words():
    rng = random.Random(6)
    return ["".join(rng.choice("abcdefghiklmnoé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def slow_ends(text):
    """Ends of chunks, from the definition."""
    raw, reach = text.encode(), chunk_dedup.REACH
    h, hashes = 0, []
    for b in raw:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    ends = []
    for i, v in enumerate(hashes):
        before, after = hashes[max(0, i - reach) : i], hashes[i + 1 : i + 1 + reach]
        if i + 1 > reach and i + 1 < len(raw) - reach and all(v < x for x in before) and all(v <= x for x in after):
            ends.append(i + 1)
    return [*ends, len(raw)] if raw else []


def test_chunks_are_those_of_the_definition(words):
    rng = random.Random(7)
    texts = [say(rng, words, n) for n in (0, 1, 5, 60, 200)] + ["x" * 20_000, "", "ab" * 40]
    number, start, length = chunk_dedup.chunk_ends([t.encode() for t in texts])
    for k, text in enumerate(texts):
        got = (start + length)[number == k].tolist()
        if text.startswith("xxx"):
            assert got == [8191, 16382, 20000]
        else:
            assert got == slow_ends(text)
        assert length[number == k].sum() == len(text.encode())


def test_passages_go_and_own_text_stays(spark, words):
    rng = random.Random(9)
    passage = say(rng, words, 60)
    rows = [(i, f"{say(rng, words, 80)} {passage} {say(rng, words, 80)}", "x") for i in range(20)]
    rows += [(100 + i, say(rng, words, 150), "x") for i in range(20)]
    rows += [(200, rows[25][1], "x"), (None, None, None), (300, "", "x"), (301, "short", "x"), (302, "short", "x"), (25, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string").repartition(4)
    got = {(r.doc_id, r.n_bytes): r for r in chunk_dedup.op5(docs).collect()}
    texts = {(r[0], len((r[1] or "").encode())): r[1] for r in rows}
    assert set(got) == set(texts)
    for (doc_id, n), r in got.items():
        if doc_id is not None and 0 < doc_id < 20:
            assert r.n_spans == 1 and 150 < r.n_removed <= len(passage.encode()) + 2, doc_id
        elif doc_id in (200, 302):
            assert r.n_removed == n
        else:
            assert r.n_removed == 0, doc_id
    kept = chunk_dedup.drop_chunks(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        if r.doc_id is not None and 0 < r.doc_id < 20:
            assert passage not in r.text and r.text.startswith(rows[r.doc_id][1][:100])


def test_removal_is_that_of_brute_force(spark, words):
    rng = random.Random(3)
    base = [say(rng, words, 40) for _ in range(8)]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, expected = {}, []
    for doc_id, text in rows:
        raw, start, again = text.encode(), 0, []
        for end in slow_ends(text):
            chunk = raw[start:end]
            if chunk in seen:
                again.append({"start": start, "length": end - start})
            seen.setdefault(chunk, 1)
            start = end
        gone = chunk_dedup.whole_characters(raw, chunk_dedup.removed(again, len(raw)))
        went = [x for x in again if any(set(range(a, b)) & set(range(x["start"], x["start"] + x["length"])) for a, b in gone)]
        expected.append((doc_id, len(raw), len(went), sum(b - a for a, b in gone), len(gone)))
    assert sorted(tuple(r)[:5] for r in chunk_dedup.op5(docs).collect()) == expected


def test_empty_table(spark):
    assert chunk_dedup.op5(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_string_ids_null_texts_and_names_of_helpers(spark, words):
    rng = random.Random(4)
    passage = " ".join(rng.choice(words) for _ in range(120))
    rows = [(f"d{k}", f"{k} " * 40 + passage + f" {k * 7}" * 40) for k in range(10, 16)] + [(None, "own " + passage), ("none", None), ("empty", "")]
    docs = spark.createDataFrame([(t, i, 1, 2, 3) for i, t in rows], "text string, doc_id string, `a.b` int, packed int, chunks int").repartition(3)
    got = chunk_dedup.drop_chunks(docs)
    assert got.columns == docs.columns
    found = {r.doc_id: r.text for r in got.collect()}
    order = [(k, t) for k, (_, t) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "")))]
    names = sorted((i for i, _ in rows), key=lambda i: (i is None, i or ""))
    numbers = spark.createDataFrame(order, "doc_id long, text string")
    assert found == {names[r.doc_id]: r.text for r in chunk_dedup.drop_chunks(numbers).collect()}
    assert found["none"] is None and found["empty"] == "" and passage in found["d10"] and passage not in found["d11"]
    assert all(r["a.b"] == 1 and r.packed == 2 and r.chunks == 3 for r in got.collect())
    assert len(chunk_dedup.op5(docs).collect()) == len(rows)
