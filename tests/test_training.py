import math
import random

import numpy as np
import pytest

from subspark.operators import cooc, counts, estimator, gradients, linalg, lm, skipgram
from subspark.sources import sinks


def slow_loss(params, rows):
    total = 0.0
    for a, b, n in rows:
        logits = [sum(x * y for x, y in zip(params["vec"][a], w)) + c for w, c in zip(params["weights"], params["bias"])]
        total += n * (math.log(sum(map(math.exp, logits))) - logits[b])
    return total


def differences(loss, params, at=1e-5):
    """Gradients by differences of the loss."""
    out = {}
    for name, p in params.items():
        out[name] = np.zeros_like(p)
        for k in np.ndindex(p.shape):
            old = p[k]
            p[k] = old + at
            up = loss()
            p[k] = old - at
            out[name][k] = (up - loss()) / (2 * at)
            p[k] = old
    return out


def test_gradients_are_differences_of_the_loss(spark, monkeypatch):
    monkeypatch.setattr(estimator, "SCORES", 20)
    rng = np.random.default_rng(3)
    params = {"vec": rng.normal(size=(7, 3)), "weights": rng.normal(size=(7, 3)), "bias": rng.normal(size=7)}
    rows = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 7, 25), rng.integers(0, 7, 25), rng.integers(1, 6, 25))]
    table = spark.createDataFrame(rows, "a int, b int, n bigint").repartition(3, "a")
    loss, weight, found = gradients.summed(table, params, estimator.pair_step(True))
    assert loss == pytest.approx(slow_loss(params, rows)) and weight == sum(n for *_, n in rows)
    for name, expected in differences(lambda: slow_loss(params, rows), params).items():
        assert np.abs(found[name] - expected).max() < 1e-5


def corpus_of_pairs():
    rng = random.Random(1)
    kinds = ["ab", "cd", "ef"]
    rows = {}
    for k, kind in enumerate(kinds):  # tokens of a kind follow those of the kind before
        for a in range(12):
            for b in range(12):
                if rng.random() < 0.8:
                    rows[f"{kind}{a}", f"{kinds[(k + 1) % 3]}{b}"] = rng.randint(1, 9)
    return [(a, b, n) for (a, b), n in rows.items()]


def test_training_stops_early_at_the_best_held_out_loss(spark):
    rows = corpus_of_pairs()
    counts = spark.createDataFrame(rows, "prev string, token string, n bigint").repartition(3)
    tokens = spark.createDataFrame([(t,) for t in {x for a, b, _ in rows for x in (a, b)} | {"never"}], "token string")
    made = estimator.train(counts, tokens, dims=8, epochs=12, batches=2, patience=2, rate=0.1, held_out=0.15)
    held = [h for _, h in made.history]
    assert made.history[-1][0] < made.history[0][0] and min(held) < math.log(37) - 0.8  # tokens of a kind: log 12 at best
    model = {r.token: r for r in made.tokens.collect()}
    assert len(model) == 37 and len(model["never"].vec) == 8
    # scores of asked pairs: the whole softmax, in one block and in four
    e, w, b = (np.array([getattr(model[t], k) for t in sorted(model)]) for k in ("vec", "weights", "bias"))
    logits = e @ w.T + b
    wanted = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    at = {t: k for k, t in enumerate(sorted(model))}
    asked = counts.select("prev", "token").union(spark.createDataFrame([("never", "ab1"), ("none", "ab1")], "prev string, token string"))
    for cells in (estimator.CELLS, 80):
        got = estimator.pair_scores(asked, made.tokens.select("token", "vec"), made.tokens.selectExpr("token", "weights AS vec", "bias"), cells).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            assert r.logp == pytest.approx(wanted[at[r.prev], at[r.token]], abs=1e-9)
    with_bias = made.tokens.selectExpr("token", "weights AS vec", "bias")
    for cells in (estimator.CELLS, 80):
        found = {r.token: r.score for r in estimator.posteriors(made.tokens.select("token", "vec"), with_bias, cells).collect()}
        assert found == pytest.approx({t: float(np.log(np.exp(wanted[:, k]).sum())) for t, k in at.items()})
    # training that goes on starts where the earlier one was best
    again = estimator.train(counts, tokens, dims=8, epochs=1, batches=1, rate=1e-9, held_out=0.15, start=made.tokens)
    assert again.history[0][1] == pytest.approx(min(held), abs=1e-5)
    # better on held-out pairs than the closed form on the same embeddings
    out = counts.selectExpr("prev", "token", "n", "cast(floor(n * 0.15 + pmod(xxhash64(prev, token, 0), 1000000) / 1000000) AS bigint) AS held")
    closed = lm.closed_form(made.tokens.select("token", "vec"), out.selectExpr("prev", "token", "n - held AS n").filter("n > 0"))
    mean = lambda scores: scores.join(out, ["prev", "token"]).selectExpr("-sum(held * logp) / sum(held) AS x").first().x
    asked = out.filter("held > 0").select("prev", "token")
    best = mean(estimator.pair_scores(asked, made.tokens.select("token", "vec"), made.tokens.selectExpr("token", "weights AS vec", "bias")))
    assert best == pytest.approx(min(held), abs=1e-9) and best < mean(lm.dot_product_model(made.tokens.select("token", "vec"), closed, asked))


def test_parameters_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(gradients, "MOST", 100)
    pairs = spark.createDataFrame([("a", "b", 1)], "prev string, token string, n bigint")
    with pytest.raises(ValueError):
        estimator.train(pairs, spark.createDataFrame([("a",), ("b",)], "token string"), dims=64)


def slow_skipgram(params, rows, own, ends, many, seed):
    """own: the bucket places of each word."""
    soft = lambda x: math.log(1 + math.exp(x))
    total = 0.0
    for a, b, n in rows:
        vec = sum((params["buckets"][p] for p in own[a]), params["input"][a]) / (1 + len(own[a]))
        drawn = skipgram.negatives_of(np.array([a]), np.array([b]), many, ends, *seed)[0]
        total += n * (soft(-vec @ params["output"][b]) + sum(soft(vec @ params["output"][c]) for c in drawn))
    return total


def test_skipgram_gradients_are_differences_of_the_loss(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "ROWS", 7)
    rng = np.random.default_rng(5)
    own = [[0, 1, 1], [2], [], [1, 3, 4], [0]]
    params = {"input": rng.normal(size=(5, 3)), "buckets": rng.normal(size=(5, 3)), "output": rng.normal(size=(5, 3))}
    starts, parts = np.cumsum([0, *map(len, own)]), np.array([p for o in own for p in o])
    ends = np.cumsum([5.0, 1, 1, 2, 3])
    rows = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 5, 20), rng.integers(0, 5, 20), rng.integers(1, 6, 20))]
    table = spark.createDataFrame(rows, "a int, b int, n bigint").repartition(2)
    loss, weight, found = gradients.summed(table, params, skipgram.pair_step(starts, parts, ends, 2, (0, 1)))
    slow = lambda: slow_skipgram(params, rows, own, ends, 2, (0, 1))
    assert loss == pytest.approx(slow()) and weight == sum(n for *_, n in rows)
    for name, expected in differences(slow, params).items():
        assert np.abs(found[name] - expected).max() < 1e-5


def test_negatives_follow_their_shares():
    ends = np.cumsum([1.0, 3.0, 0.0, 6.0])
    drawn = skipgram.negatives_of(np.arange(4000), np.arange(4000) * 7, 5, ends, 3, 1)
    shares = np.bincount(drawn.ravel(), minlength=4) / drawn.size
    assert np.abs(shares - [0.1, 0.3, 0, 0.6]).max() < 0.02
    assert (drawn == skipgram.negatives_of(np.arange(4000), np.arange(4000) * 7, 5, ends, 3, 1)).all()


def test_words_of_a_kind_get_near_vectors_and_unknown_words_too(spark, tmp_path):
    rng = random.Random(3)
    kinds = [[f"{stem}{end}" for end in ("a", "o", "is", "ont", "ez", "ly")] for stem in ("walk", "grün", "solve")]
    lines = [" ".join(rng.choice(kinds[k % 3]) for _ in range(8)) for k in range(90)]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    vocab = counts.top_words(counts.word_counts(table), 100)
    made = skipgram.train(cooc.word_word(table, vocab, 3), vocab, dims=6, epochs=25, batches=1, buckets=5000, rate=0.1)
    assert made.losses[-1] < 0.8 * made.losses[0]
    vec = {r.word: np.array(r.vec) for r in made.words.collect()}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    near = np.mean([cosine(vec[a], vec[b]) for k in kinds for a in k for b in k if a != b])
    far = np.mean([cosine(vec[a], vec[b]) for i in range(3) for j in range(3) if i != j for a in kinds[i] for b in kinds[j]])
    assert len(vec) == 18 and near > far + 0.3
    unknown = spark.createDataFrame([("walking",), ("grünlich",), ("xq",)], "word string")
    got = {r.word: np.array(r.vec) for r in skipgram.vectors_of(unknown, made.buckets, 5000).collect()}
    for word, k in (("walking", 0), ("grünlich", 1)):
        means = [np.mean([cosine(got[word], vec[w]) for w in kind]) for kind in kinds]
        assert means.index(max(means)) == k
    output = np.array([r.vec for r in made.output.orderBy("id").collect()])
    inverse = np.linalg.pinv(output)
    for r in linalg.pseudo_inverse(made.output).collect():
        assert r.x == pytest.approx(inverse[r.dim, r.id], abs=1e-6)
    sinks.trained_vectors(made, f"{tmp_path}/made")
    lines = lambda name: [r.value for r in spark.read.text(f"{tmp_path}/made.{name}").collect()]
    assert set(lines("vocab")) == set(vec) and len(lines("txt")) == 19
    rows = np.array([[float(x) for x in line.split()] for line in lines("out_inv.txt")])
    assert rows.shape == (6, 18) and np.allclose(np.sort(rows.ravel()), np.sort(inverse.ravel()), atol=1e-6)


@pytest.mark.parametrize("pairs", [skipgram.PAIRS, 40])
def test_vectors_beyond_the_bound_are_trained_as_tables(spark, monkeypatch, pairs):
    rng = random.Random(4)
    words = [f"{stem}{end}" for stem in ("walk", "grün") for end in ("a", "is", "ez")] + ["x"]
    table = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(8)),) for _ in range(12)], "line string")
    vocab = counts.top_words(counts.word_counts(table), 100)
    near = cooc.word_word(table, vocab, 2)
    train = lambda: skipgram.train(near, vocab, dims=3, epochs=1, batches=2, negatives=2, buckets=50, rate=0.1, seed=7)
    rows = lambda made: [{r[0]: r[-1] for r in t.collect()} for t in (made.words, made.buckets, made.output)]
    wanted = train()
    monkeypatch.setattr(gradients, "MOST", 10)
    monkeypatch.setattr(skipgram, "PAIRS", pairs)  # cells of several groups, too
    found = train()
    assert found.losses == pytest.approx(wanted.losses)
    for one, other in zip(rows(found), rows(wanted), strict=True):
        assert one.keys() == other.keys()
        for key, vec in one.items():
            assert vec == pytest.approx(other[key], abs=1e-7)


def test_tokens_outside_a_vocabulary_count_as_one(spark):
    rows = [("a", "b", 2), ("a", "x", 1), ("y", "x", 3), ("z", "x", 4), ("y", "b", 5), ("###", "y", 6)]
    table = spark.createDataFrame(rows, "prev string, token string, n bigint")
    vocab = spark.createDataFrame([("a",), ("b",), ("###",)], "token string")
    got = {(r.prev, r.token): r.n for r in lm.folded(table, vocab).collect()}
    assert got == {("a", "b"): 2, ("a", "<unk>"): 1, ("<unk>", "<unk>"): 7, ("<unk>", "b"): 5, ("###", "<unk>"): 6}
