"""A bigram model by products of vectors: log softmax of (embedding of prev . weights of token + bias), trained by
mini-batches over counted pairs, and its scores for asked pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspark.operators.gradients import Adam, bounded, groups_of, summed
from subspark.plans.store import stored

#: Numbers of weights that go to tasks at a time, and of a table of scores in a task.
CELLS, SCORES = 8_000_000, 2_000_000


@dataclass
class Trained:
    """tokens: (token, vec, weights, bias), those of the best held-out loss. history: (loss, held-out loss) by epoch."""

    tokens: DataFrame
    history: list[tuple[float, float]]


def pair_step(learn: bool):
    """A step over rows (a, b, n), those of an `a` together: the loss of counted pairs, and its gradients if asked for."""

    def step(batches, params, gradients):
        e, w, bias = params["vec"], params["weights"], params["bias"]
        loss = weight = 0.0
        many = max(1, SCORES // max(len(w), 1))
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in range(3))
            if not len(a):
                continue
            order = np.argsort(a, kind="stable")
            a, b, n = a[order], b[order], n[order].astype(float)
            heads, of = groups_of(a)
            ends = np.searchsorted(of, np.arange(len(heads) + 1))
            for low in range(0, len(heads), many):
                own = heads[low : low + many]
                some = slice(ends[low], ends[min(low + many, len(heads))])
                at, to, times = of[some] - low, b[some], n[some]
                logits = e[own] @ w.T + bias
                top = logits.max(axis=1, keepdims=True)
                shares = np.exp(logits - top)
                total = shares.sum(axis=1, keepdims=True)
                loss += float((times * (top + np.log(total))[at, 0]).sum() - (times * logits[at, to]).sum())
                weight += float(times.sum())
                if learn:
                    shares *= np.bincount(at, times, len(own))[:, None] / total
                    np.subtract.at(shares, (at, to), times)
                    np.add.at(gradients["vec"], own, shares @ w)
                    gradients["weights"] += shares.T @ e[own]
                    gradients["bias"] += shares.sum(axis=0)
        return loss, weight

    return step


def train(counts: DataFrame, tokens: DataFrame, dims: int = 64, epochs: int = 30, batches: int = 4, patience: int = 3, rate: float = 0.02, held_out: float = 0.05, seed: int = 0, start: DataFrame | None = None) -> Trained:
    """counts: (prev, token, n), tokens: (token), all that occur in counts or may.

    Of a pair's observations a share of `held_out` is held out, rounded by a hash of it and the seed, and the others belong
    to one of the `batches` of each epoch. Pairs of one prev lie in one task, so that its scores over all tokens are
    found once for a batch. Training ends after `epochs`, or
    `patience` of them without a better loss on the held-out pairs; the best parameters count. All tokens' vectors must
    fit in a task (gradients.MOST numbers). start: tokens of an earlier training (token, vec, weights, bias), from which
    tokens that it has go on."""
    from subspark.operators.counts import ranked

    spark = counts.sparkSession
    ids = stored(ranked(tokens.select("token").distinct(), "token").withColumn("id", F.col("id").cast("int")), "estimator_tokens")
    size = ids.count()
    rng = np.random.default_rng(seed)
    params = {"vec": rng.normal(0, 1 / np.sqrt(dims), (size, dims)), "weights": rng.normal(0, 1 / np.sqrt(dims), (size, dims)), "bias": np.zeros(size)}
    bounded(params)
    if start is not None:
        before = ids.join(start.select("token", "vec", "weights", "bias"), "token").select("id", "vec", "weights", "bias").toArrow()
        at = before.column(0).to_numpy()
        for name, column in zip(params, before.columns[1:], strict=True):
            if len(at):
                params[name][at] = np.array(column.to_pylist())
    draw = F.pmod(F.xxhash64("prev", "token", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    pairs = (
        counts.groupBy("prev", "token").agg(F.sum("n").alias("n")).withColumn("draw", draw)
        .join(ids.select(F.col("token").alias("prev"), F.col("id").alias("a")), "prev").join(ids.withColumnRenamed("id", "b"), "token")
    )
    held = F.floor(F.col("n") * held_out + F.col("draw")).cast("long")
    batch = F.pmod(F.xxhash64("token", "prev", F.lit(seed)), F.lit(batches)).cast("int")
    both = F.explode(F.array(F.struct(batch.alias("batch"), (F.col("n") - held).alias("n")), F.struct(F.lit(-1).alias("batch"), held.alias("n"))))
    dealt = pairs.select("a", "b", both.alias("x")).select("a", "b", "x.n", "x.batch").filter("n > 0")
    path = stored(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a").sortWithinPartitions("batch", "a"), "estimator_pairs")
    adam, history, best, since = Adam(params, rate), [], None, 0
    take = lambda k: path.filter(F.col("batch") == k).select("a", "b", "n")
    for _ in range(epochs):
        total = weight = 0.0
        for k in range(batches):
            loss, times, found = summed(take(k), params, pair_step(True))
            if times:
                adam.step({name: g / times for name, g in found.items()})
                total, weight = total + loss, weight + times
        loss, times, _ = summed(take(-1), params, pair_step(False))
        history.append((total / max(weight, 1), loss / times if times else total / max(weight, 1)))
        if best is None or history[-1][1] < min(h[1] for h in history[:-1]):
            best, since = {k: p.copy() for k, p in params.items()}, 0
        else:
            since += 1
            if since >= patience:
                break
    found = best or params
    lists = pa.list_(pa.float64())
    table = pa.table({"id": pa.array(np.arange(size), pa.int32()), "vec": pa.array(list(found["vec"]), lists), "weights": pa.array(list(found["weights"]), lists), "bias": pa.array(found["bias"], pa.float64())})
    kept = ids.join(spark.createDataFrame(table, "id int, vec array<double>, weights array<double>, bias double"), "id")
    return Trained(stored(kept.select("token", "vec", "weights", "bias"), "estimator"), history)


def pair_scores(pairs: DataFrame, embeddings: DataFrame, weights: DataFrame, cells: int = CELLS) -> DataFrame:
    """pairs: (prev, token), embeddings: (token, vec), weights: (token, vec, bias if it has one). (prev, token, logp) for the
    distinct pairs whose tokens both have vectors.

    Weights go to tasks in blocks of `cells` numbers, and a block's pairs with them; a block gives each prev the log of
    its summed exponentials and the scores of the pairs that lie in it. No table of all pairs of tokens is made."""
    spark = pairs.sparkSession
    from subspark.operators.counts import ranked

    bias = F.col("bias") if "bias" in weights.columns else F.lit(0.0)
    # numbers in order of the tokens, so that a block is a range of them
    numbered = stored(ranked(weights.select("token", F.col("vec").cast("array<double>").alias("w"), bias.alias("bias")), "token"), "weights")
    size, dims = numbered.count(), numbered.select(F.max(F.size("w"))).first()[0] or 1
    step = max(1, cells // dims)
    asked = pairs.select("prev", "token").distinct().join(numbered.select("token", "id"), "token")
    lists = asked.groupBy("prev").agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("asked"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = stored(lists.join(embeddings.select(F.col("token").alias("prev"), F.col("vec").cast("array<double>").alias("vec")), "prev").repartition(n, "prev"), "asked_pairs")
    parts = []
    for low in range(0, size, step):
        block = numbered.filter((F.col("id") >= low) & (F.col("id") < low + step)).select("id", "w", "bias").orderBy("id").toArrow()
        parts.append(_block_scores(heads, block, low))
    if not parts:
        return spark.createDataFrame([], "prev string, token string, logp double")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = stored(found, "block_scores")
    sums = found.filter("token is null").groupBy("prev").agg(F.max("x").alias("top"), F.collect_list("x").alias("xs"))  # a number for each block
    rest = sums.select("prev", (F.col("top") + F.log(F.aggregate(F.transform("xs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))).alias("rest"))
    return found.filter("token is not null").join(rest, "prev").select("prev", "token", (F.col("x") - F.col("rest")).alias("logp"))


def _block_scores(heads: DataFrame, block: pa.Table, low: int) -> DataFrame:
    """(prev, token, x): the score of each asked pair in the block, and under a null token the log of the block's sum."""
    shared = heads.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        w = np.array(shared.value.column(1).to_pylist())
        bias = shared.value.column(2).to_numpy()
        high = low + len(w)
        many = max(1, SCORES // max(len(w), 1))
        for batch in batches:
            for k in range(0, batch.num_rows, many):
                some = batch.slice(k, many)
                names = some.column(0).to_pylist()
                logits = np.array(some.column(2).to_pylist()) @ w.T + bias
                top = logits.max(axis=1)
                sums = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
                prev, token, x = list(names), [None] * len(names), sums.tolist()
                for i, own in enumerate(some.column(1).to_pylist()):
                    for pair in own:
                        if low <= pair["id"] < high:
                            prev.append(names[i])
                            token.append(pair["token"])
                            x.append(float(logits[i, pair["id"] - low]))
                yield pa.RecordBatch.from_arrays([pa.array(prev, pa.string()), pa.array(token, pa.string()), pa.array(x, pa.float64())], names=["prev", "token", "x"])

    return heads.select("prev", "asked", "vec").mapInArrow(run, "prev string, token string, x double")


def posteriors(embeddings: DataFrame, weights: DataFrame, cells: int = CELLS) -> DataFrame:
    """embeddings: (token, vec), weights: (token, vec, bias if it has one). (token, score): the log of the sum of a token's
    probabilities after each prev. Blocks of weights meet blocks of embeddings in tasks; sums by token leave them."""
    from subspark.operators.counts import ranked

    bias = F.col("bias") if "bias" in weights.columns else F.lit(0.0)
    numbered = stored(ranked(weights.select("token", F.col("vec").cast("array<double>").alias("w"), bias.alias("bias")), "token"), "weights")
    size, dims = numbered.count(), numbered.select(F.max(F.size("w"))).first()[0] or 1
    step = max(1, cells // dims)
    n = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = stored(embeddings.select(F.col("token").alias("prev"), F.array().cast("array<struct<id:long,token:string>>").alias("asked"), F.col("vec").cast("array<double>").alias("vec")).repartition(n, "prev"), "embeddings")
    blocks = [numbered.filter((F.col("id") >= low) & (F.col("id") < low + step)).select("id", "w", "bias", "token").orderBy("id").toArrow() for low in range(0, size, step)]
    if not blocks:
        return embeddings.sparkSession.createDataFrame([], "token string, score double")
    sums = _block_scores(heads, blocks[0], 0)
    for k, block in enumerate(blocks[1:], 1):
        sums = sums.unionByName(_block_scores(heads, block, k * step))
    tops = sums.groupBy("prev").agg(F.max("x").alias("top"), F.collect_list("x").alias("xs"))  # a number for each block
    rest = tops.select("prev", (F.col("top") + F.log(F.aggregate(F.transform("xs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))).alias("rest"))
    shifted = stored(heads.join(rest, "prev").select("prev", "vec", "rest"), "normalised")
    parts = [_token_sums(shifted, block) for block in blocks]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    top = F.max("x").alias("top")
    best = found.groupBy("token").agg(top, F.collect_list("x").alias("xs"))  # a number for each task
    return best.select("token", (F.col("top") + F.log(F.aggregate(F.transform("xs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))).alias("score"))


def _token_sums(heads: DataFrame, block: pa.Table) -> DataFrame:
    """heads: (prev, vec, rest). (token, x): the log of the block's tokens' probabilities, summed over a task's rows."""
    shared = heads.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        w = np.array(shared.value.column(1).to_pylist())
        bias = shared.value.column(2).to_numpy()
        total = np.full(len(w), -np.inf)
        many = max(1, SCORES // max(len(w), 1))
        for batch in batches:
            for low in range(0, batch.num_rows, many):
                some = batch.slice(low, many)
                logs = np.array(some.column(1).to_pylist()) @ w.T + bias - some.column(2).to_numpy()[:, None]
                total = np.logaddexp(total, np.logaddexp.reduce(logs, axis=0))
        if np.isfinite(total).any():
            yield pa.RecordBatch.from_arrays([shared.value.column(3).combine_chunks(), pa.array(total)], names=["token", "x"])

    return heads.select("prev", "vec", "rest").mapInArrow(run, "token string, x double")
