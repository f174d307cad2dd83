import random
import sys
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from subspark.llm import packing, pieces, token_counts

ODD = [
    None, "", " \n\t ", "One", "It's, isn't. We'll...go! <|endoftext|> x<|endoftext|>. <|ENDOFTEXT|> <|startoftext|>",
    "A\x1cb c\x1f.d\x85e f", "İstanbul ΣΑΣ. ²½ x². 中文，字 é. \U0001f600, Ångstrom", "don't." * 300,
    "PENDİ. KADIKÖYLÜ İ.", "\u0906\u0935\u093e\u095b, \u09dd! \ufb2a?",
    "word " * 5000, "x" * 3000, "1,234.5 a,b.c a.,", "\x00 a\x00b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pieces.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (4, ODD[4]), (4, ODD[4])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library, docs, monkeypatch):
    made = pieces.Pieces(pieces.read(None))
    for limit, step in ((400_000, 1 << 20), (20, 50)):
        monkeypatch.setattr(pieces, "CACHE", limit)
        monkeypatch.setattr(pieces, "CORES", limit)
        monkeypatch.setattr(pieces, "SLICE", step)
        for row in docs.collect():
            if row.text:
                assert np.frombuffer(made.ids(row.text), "<u4").tolist() == ids_of(library, row.text)
        texts = [row.text or "" for row in docs.collect()]
        assert [np.frombuffer(x, "<u4").tolist() for x in made.ids_of(texts)] == [ids_of(library, t) for t in texts]


def test_ids_of_random_unicode_are_the_librarys(library):
    """Letters that end in a mark after NFC and lower case, and random strings of several scripts."""
    made = pieces.Pieces(pieces.read(None))
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    marked = [c for c in chars if c.isalpha() and not unicodedata.normalize("NFC", c).lower()[-1].isalpha()]
    assert "\u0130" in marked and "\u095b" in marked
    rng = random.Random(6)
    blocks = [(0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xA80), (0x1100, 0x1200), (0x1E00, 0x2100), (0, 0x110000)]
    pools = [list(" .,'!<=>s\x85\xa0\u3000"), marked, *([c for c in chars[a : min(b, len(chars))]] for a, b in blocks)]
    texts = [f"a{c}. {c}, {c}" for c in marked]
    for _ in range(20_000):
        own = rng.choice(pools)
        texts.append("".join(rng.choice(own if rng.random() < 0.7 else rng.choice(pools)) for _ in range(rng.randint(1, 12))))
    expected = library.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, expected) if np.frombuffer(made.ids(t), "<u4").tolist() != e.ids] == []


def test_counts_are_the_librarys(library, docs):
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(ids_of(library, r.text)), n > 2048) for r in docs.collect()]
    assert sorted(map(tuple, token_counts.op7(docs).collect()), key=str) == sorted(expected, key=str)


def test_pieces_tile_documents_and_sequences(library, docs):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(np.array([*ids_of(library, r.text), 2], "<u4"))
    rows = packing.op1(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        own = texts[doc_id]
        assert len({t.tobytes() for t in own}) == 1  # repeated rows only
        assert sum(p.length for p in parts) == sum(map(len, own))
        for p in parts:
            assert p.doc_tokens == len(own[0])
            assert p.ids_crc32 == zlib.crc32(own[0][p.start : p.start + p.length].tobytes())
    for k, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or k == max(by_sequence)
    made = {r.sequence_id: r for r in packing.sequences(docs).collect()}
    assert set(made) == set(by_sequence)
    for k, r in made.items():
        assert r.n_tokens == sum(p.length for p in by_sequence[k])
        for p in by_sequence[k]:
            assert zlib.crc32(np.array(r.ids[p.offset : p.offset + p.length], "<u4").tobytes()) == p.ids_crc32


@pytest.mark.parametrize("size", [4096, 16])
def test_windows_hold_the_line_of_all_tokens(library, docs, size):
    """Whole windows and those put together from boundary records; small ones end inside documents often."""
    own = {r.doc_id: np.array([*ids_of(library, r.text), 2], "<u4") for r in docs.collect()}
    rows = sorted(packing.windows(docs, size=size).collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    assert all(len(r.ids) == 4 * size for r in rows[:-1])
    for r in rows:
        parts = [own[d][s : s + n] for d, s, n in zip(r.docs, r.starts, r.lengths)]
        assert np.concatenate(parts).tobytes() == bytes(r.ids) and r.sizes == [len(own[d]) for d in r.docs]
    places = [(d, s, n) for r in rows for d, s, n in zip(r.docs, r.starts, r.lengths)]
    for (d, s, n), (e, t, _) in zip(places, places[1:]):
        assert (e, t) == (d, s + n) if s + n < len(own[d]) else t == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.op1(none).collect() == token_counts.op7(none).collect() == packing.sequences(none).collect() == []


def test_words_that_come_again_are_remembered_when_the_first_ones_are_not(library, monkeypatch):
    monkeypatch.setattr(pieces, "CORES", 0)
    made = pieces.Pieces(pieces.read(None))
    texts, asked = ["Seldom, the seldom word.", "the word; seldom"], []
    encode = made.encode
    monkeypatch.setattr(made, "encode", lambda tokens: asked.append(len(tokens)) or encode(tokens))
    for _ in range(4):
        assert [np.frombuffer(x, "<u4").tolist() for x in made.ids_of(texts)] == [ids_of(library, t) for t in texts]
    assert asked[0] == 6 and len(asked) == 2  # seldom, the, word and three signs, twice
