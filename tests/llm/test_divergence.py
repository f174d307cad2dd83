import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from subspark.llm import divergence


def terms_of(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_audit(rows, least=3, top=200):
    """rows: (text, lang, source). All pairs of sources over all kept terms, in Python's whole numbers."""
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms_of(text)
        counts[lang or "", source or ""].update(found)
        holders[lang or ""].update(set(found))
    out = []
    for lang in holders:
        kept = [t for t, n in holders[lang].items() if n >= least]
        sources = [s for x, s in counts if x == lang]
        number = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        share = {}
        for s in sources:
            total = sum(number[s].values()) + len(kept)
            share[s] = {t: 1 + 10**9 * (number[s][t] + 1) // total for t in kept}
        whole = {t: sum(number[s][t] for s in sources) for t in kept}
        total = sum(whole.values()) + len(kept)
        q = {t: 1 + 10**9 * (whole[t] + 1) // total for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            words = [(f(share[s][t], q[t]), t) for t in kept if number[s][t] and share[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for _ in range(400):
        source = rng.choice(["hot"] * 5 + [f"s{k}" for k in range(6)])
        own = words if source == "hot" else words[hash_of(source) % 100 :]
        text = rng.choice([" ", "1", "\n", "-"]).join(rng.choice(own).upper() if rng.random() < 0.2 else rng.choice(own) for _ in range(rng.randint(0, 25)))
        rows.append((text, rng.choice(["x", "x", "y", "é", None]), source))
    return rows + [(None, "x", "no text"), ("1 2 3", "only", "digits"), ("a b", "few", "a"), ("a b", "few", "b"), ("ab " * 5000, "y", None), rows[0], rows[0]]


def hash_of(source):
    return sum(map(ord, source)) * 37


@pytest.mark.parametrize("options", [{}, {"most": 3, "held": 50}])
def test_audit_is_brute_force(spark, options, monkeypatch):
    rows = corpus()
    if options:
        monkeypatch.setattr(divergence, "CELLS", 30)  # blocks of langs, and no array of all pairs
        monkeypatch.setattr(divergence.corrections, "__defaults__", (30,))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int").repartition(5)
    got = sorted(map(tuple, divergence.audit(docs, **options).collect()))
    assert got == slow_audit(rows)


def test_only_so_many_terms_are_ranked(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs, top=7).collect())) == slow_audit(rows, top=7)


def test_shares_stay_exact_for_large_counts(spark):
    rng = random.Random(2)
    cases = [(0, 0, 1), (5, 10**12, 10**6)] + [(c, n, v) for n, v in ((10**15, 10**7), (7 * 10**15, 3)) for c in (0, n, rng.randint(0, n), rng.randint(0, n))]
    expected = [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c long, n long, v long")
    assert [r.p for r in frame.selectExpr("k", f"{divergence.share_expr('c', 'n', 'v')} AS p").orderBy("k").collect()] == expected
    c, n, v = np.array(cases, np.int64).T
    assert divergence.shares(c, n + v).tolist() == expected


def test_empty_table(spark):
    assert divergence.op12(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
