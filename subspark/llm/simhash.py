"""SimHash near-dedup by a binary trie self-join.

Each text gets a 64-bit fingerprint. Two fingerprints link when they differ in at most `BUDGET` = 3
bits. Distinct fingerprints are dealt out by each of their four 16-bit blocks: a pair within three
bits has one block in common. What shares a block is a subtree below an empty error count, and the
self-join walks pairs of its nodes together, bit by bit, adds up the differing bits and drops a pair
of nodes once the sum is over the budget. Copies of one fingerprint are one leaf. Each subtree emits
a spanning forest of its links, so that what leaves a task is no more than its fingerprints; pairs of
nodes that lie in one component already are skipped.

A block value that holds over `SUBTREE` fingerprints is dealt out again by blocks of its other bits
(the pair has one of those in common as well, for the same reason), down to `LEVELS` levels, so that
no task gets a large group.

Nulls: a null text has no shingles, and the fingerprint 0, which links like any other. A null doc_id
takes part, and is never the smallest of a component unless all are null. Repeated rows are copies. An empty
table gives no rows. Very long texts are hashed as a whole in their task. Ids may have any type that has an
order; extra columns aren't read by `near_duplicates` and are carried by `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspark.llm.common import binary_texts, doc_key, fresh, lowered, release, stored
from subspark.llm.components import components

SEED, BUDGET, BITS = 42, 3, 64
SUBTREE = 50_000
LEVELS = 4
#: Node pairs that a walk holds at once.
WALK = 100_000
#: Rows of subtrees that a task walks together.
TOGETHER = 50_000


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def ones_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many hashes have each bit set. Words beyond the first are remixed from it."""
    ones = np.zeros(BITS * words, np.int64)
    for k in range(0, len(hashes), 32_768):
        part = hashes[k : k + 32_768]
        wide = np.empty((len(part), words), np.uint64)
        for w in range(words):
            wide[:, w] = part
            with np.errstate(over="ignore"):
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                part = part ^ (part >> np.uint64(29))
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return ones


def fingerprint(text: bytes, size: int = 3, words: int = 1) -> bytes:
    """Little-endian 64-bit words. A bit is 1 if it is set in over half the hashes of the text's shingles."""
    return bits_of(shingle_hashes(text, size), words)


def bits_of(hashes: np.ndarray, words: int) -> bytes:
    return np.packbits(2 * ones_of(hashes, words) > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, k1, k2, fp long, wide binary): fp is the fingerprint itself if it has one word, else a hash of the
    set of shingles; wide is null if it has one word."""

    def run(batches):
        for batch in batches:
            if words == 1:
                wide = [fingerprint(t, size) for t in binary_texts(batch.column(1))]
                fp = np.frombuffer(b"".join(wide), np.int64)
            else:
                wide, sets = [], []
                for t in binary_texts(batch.column(1)):
                    hashes = shingle_hashes(t, size)
                    wide.append(bits_of(hashes, words))
                    sets.append(xxhash.xxh64_intdigest(np.unique(hashes).tobytes()))
                fp = np.array(sets, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(fp), pa.array([None] * len(wide) if words == 1 else wide, pa.binary())],
                names=["doc_id", "k1", "k2", "fp", "wide"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2")).mapInArrow(
        run, f"doc_id {kind}, k1 long, k2 long, fp long, wide binary"
    )


class _Forest:
    """Union of positions; labels are the smallest position of each set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Gives the links of which each joined two sets: a spanning forest of the new ones."""
        taken = []
        la, lb = self.label[a], self.label[b]
        open_ = np.flatnonzero(la != lb)
        while len(open_):
            high, low = np.maximum(la[open_], lb[open_]), np.minimum(la[open_], lb[open_])
            # each set with a lower neighbour is put under one of them
            roots, first = np.unique(high, return_index=True)
            taken.append(open_[first])
            parent = np.arange(len(self.label))
            parent[roots] = low[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]
            la, lb = self.label[a], self.label[b]
            open_ = open_[la[open_] != lb[open_]]
        return taken


def trie_links(values: np.ndarray, groups: np.ndarray, budget: int = BUDGET, bits: int = BITS, wide: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each group, as positions. values: distinct in a group; sorted by
    (group, value). With wide fingerprints (a row of words for each value), a link has at most `most` of their bits
    differ as well, and equal values may repeat in a group."""
    out = [*_walk(values, groups, _Forest(len(values)), budget, bits, wide, most)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _walk(values, groups, forest: _Forest, budget: int, bits: int, wide, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest. The trie's nodes are ranges of positions: bit by bit, a range is cut where the bit
    sets in."""
    n = len(values)
    sums = [None] * bits
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    ends = np.concatenate((starts[1:], [n]))
    big = ends - starts > 1
    first = np.stack([starts[big], ends[big], starts[big], ends[big], np.zeros(big.sum(), np.int64)])
    stack = [(bits - 1, first)] if first.size else []

    def ones(bit: int) -> np.ndarray:
        if sums[bit] is None:
            sums[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return sums[bit]

    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > WALK:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
            continue
        # one leaf each, or no bits left: count the differing bits at once
        a0, a1, b0, b1, err = pairs
        leaf = ((a1 - a0 == 1) & (b1 - b0 == 1)) | (bit < 0)
        for x, y in _crossed(forest, a0[leaf], a1[leaf], b0[leaf], b1[leaf]):
            near = (forest.label[x] != forest.label[y]) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            x, y = x[near], y[near]
            if wide is not None:
                near = np.bitwise_count(wide[x] ^ wide[y]).sum(1, dtype=np.int64) <= most
                x, y = x[near], y[near]
            for k in forest.unite(x, y):
                yield x[k], y[k]
        # nodes of which all leaves are in one component need no look
        change = np.concatenate(([0], np.cumsum(forest.label[1:] != forest.label[:-1])))
        done = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (forest.label[a0] == forest.label[b0])
        pairs = pairs[:, ~(leaf | done)]
        if bit < 0 or not pairs.shape[1]:
            continue
        a0, a1, b0, b1, err = pairs
        c = ones(bit)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        kids = [
            np.stack([a0, am, b0, bm, err]),
            np.stack([am, a1, bm, b1, err]),
            np.stack([a0, am, bm, b1, err + 1]),
            np.stack([am[~same], a1[~same], b0[~same], bm[~same], err[~same] + 1]),
        ]
        kids = np.concatenate(kids, axis=1)
        kids = kids[:, (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)]
        if kids.shape[1]:
            stack.append((bit - 1, kids))


def _crossed(forest: _Forest, a0, a1, b0, b1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions from two ranges, about WALK at a time. Neighbours come first; ranges that are in one
    component by then need no other pair."""
    one = (a1 - a0 == 1) & (b1 - b0 == 1)
    yield a0[one], b0[one]
    for lo, hi, lo2, hi2 in zip(a0[~one], a1[~one], b0[~one], b1[~one], strict=True):
        x = np.arange(lo, max(hi, hi2) - 1)
        yield x, x + 1
        rows = max(1, WALK // (hi2 - lo2))
        for k in range(lo, hi, rows):
            if (forest.label[lo:hi] == forest.label[lo]).all() and (forest.label[lo2:hi2] == forest.label[lo]).all():
                break
            x = np.arange(k, min(hi, k + rows))
            yield np.repeat(x, hi2 - lo2), np.tile(np.arange(lo2, hi2), len(x))


def _by_key(rows: DataFrame, links: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]], weigh: Callable[[pa.RecordBatch], int]) -> DataFrame:
    """rows: (key, more). (a, b): links of tables of whole keys, of about TOGETHER by weight."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b in links(table):
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += weigh(batch)
            if n >= TOGETHER:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    yield from found(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
                    n = sum(map(weigh, held))
        if held:
            yield from found(pa.Table.from_batches(held))
        held = []
        release()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _walked(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """rows: (key, fp, piece long, wide). Links inside each key, as (a, b)."""

    def links(table: pa.Table):
        keys, fps = table.column("key").to_numpy(), table.column("fp").to_numpy()
        pieces = table.column("piece").to_numpy().view(np.uint64)
        order = np.lexsort((pieces, keys))
        wide = None
        if most:
            raw = b"".join(table.column("wide").to_pylist())
            wide = np.frombuffer(raw, np.uint64).reshape(len(keys), -1)[order]
        a, b = trie_links(pieces[order], keys[order], BUDGET, bits, wide, most)
        yield fps[order][a], fps[order][b]

    return _by_key(rows, links, lambda batch: batch.num_rows)


def _blocks(free: list[int]) -> list[list[int]]:
    """Bit positions in BUDGET + 1 blocks of about equal size."""
    return [part.tolist() for part in np.array_split(np.array(free), BUDGET + 1)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def fingerprint_links(distinct: DataFrame, pieces: int = 1, most: int = 0) -> DataFrame:
    """distinct: (fp long, wide), no fp twice. Links (a, b) of a forest that joins what all pairs of fingerprints
    with some piece within the budget, and with at most `most` differing bits in all (0: any), would join."""
    bits = BITS if pieces == 1 else PIECE
    if pieces == 1:
        level = distinct.select("fp", F.lit(None).cast("binary").alias("wide"), F.lit(0).alias("nth"), F.col("fp").alias("piece"))
    else:
        values = F.array(*[_piece(F.col("wide"), k) for k in range(pieces)])
        level = distinct.select("fp", "wide", F.posexplode(values).alias("nth", "piece"))
    level = level.withColumn("mask", F.lit(0).cast("long"))
    out, masks = None, [0]
    for depth in range(LEVELS):
        # each fingerprint goes to one group for each block of the bits that its group doesn't share yet
        plans = {m: [m | sum(1 << k for k in block) for block in _blocks([k for k in range(bits) if not m >> k & 1])] for m in masks}
        news = F.create_map(*[x for m, to in plans.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(t)).cast("long") for t in to]))])
        dealt = level.withColumn("mask", F.explode(news[F.col("mask")]))
        masks = sorted({t for to in plans.values() for t in to})
        keyed = dealt.withColumn("key", F.xxhash64("nth", "mask", F.col("piece").bitwiseAND(F.col("mask"))))
        large = stored(keyed.groupBy("key").count().filter(F.col("count") > SUBTREE), "subtrees")
        large = None if large.isEmpty() else large
        parts = [keyed if large is None else keyed.join(large, "key", "left_anti")]
        if large is not None and depth == LEVELS - 1:
            parts.append(_parted(keyed, large))
        for part in parts:
            walked = _walked(part.select("key", "fp", "piece", "wide"), bits, most)
            out = walked if out is None else out.unionByName(walked)
        if large is None or depth == LEVELS - 1:
            break
        level = stored(keyed.join(large, "key", "left_semi").drop("key").dropDuplicates(["fp", "nth", "mask"]), "subtree_rows")
    return out


def _parted(keyed: DataFrame, large: DataFrame) -> DataFrame:
    """keyed: (key, fp, more), large: (key, count). The rows of large keys, which no further bits part: in parts of about
    SUBTREE / 2 by hash, each two of which are a group, so that no task holds a whole key."""
    sized = large.select("key", F.ceil(F.col("count") * 2 / SUBTREE).cast("int").alias("parts"))
    rows = keyed.join(sized, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a part's own group would be part of each of its others
    rows = rows.filter((F.col("own") != F.col("other")) | (F.col("parts") == 1))
    return rows.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))


def _piece(wide, k: int):
    """The k-th PIECE bits of a fingerprint, as a long."""
    size = PIECE // 8
    return F.conv(F.hex(F.substring(wide, size * k + 1, size)), 16, 10).cast("long")


def groups_of(marked: DataFrame, links: Callable[[DataFrame], DataFrame] = fingerprint_links) -> DataFrame:
    """marked: (doc_id, fp, wide, more). (fp, component, component_id), with component_id the smallest doc_id that fp's
    links reach. links gives them, as (a, b), from the distinct (fp, wide)."""
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("wide").alias("wide"))
    roots = components(links(first.select("fp", "wide")))
    # only linked fingerprints have a root; the others are components of their own
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("root_id"))
    merged = linked.join(smallest, "root").select("fp", "root", "root_id")
    return stored(
        first.join(merged, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("component"), F.coalesce("root_id", "first_id").alias("component_id")
        ),
        "groups",
    )


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document."""
    marked = stored(fingerprints(docs, size), "fingerprints")
    return marked.join(groups_of(marked), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: 64-bit words of a wide fingerprint, and the most of its bits that a candidate pair may differ in. Texts of a Jaccard
#: similarity of 0.8 over five-word shingles differ in about 47 of the 320 bits (deviation 6), unrelated ones in half.
WORDS, MOST = 5, 76
#: Bits of a wide fingerprint's pieces, one trie each.
PIECE = 32
#: Members and shingles of a block of candidates that one task verifies.
MEMBERS, SHINGLES = 4_000, 1_500_000
#: Holders of a member's shingles that are counted at once.
AT_ONCE = 400_000


def shingle_sets(docs: DataFrame, marked: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """classes: (fp, class). (class, fp, shingles array<long>): the distinct shingle hashes of each fp, from one of its
    texts."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)) for t in binary_texts(batch.column(2))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["class", "fp", "shingles"])

    one = marked.join(classes, "fp").groupBy("class", "fp").agg(F.min(F.struct("k1", "k2")).alias("key")).select("class", "fp", "key.*")
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text").join(one, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return texts.select("class", "fp", "text").mapInArrow(run, "class long, fp long, shingles array<long>")


def near_members(keys: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs of a key, one of them `left` and the other `right`, whose sets have a Jaccard similarity of
    0.8 or more. Members are sorted by key; member i has counts[i] of the shingles, in order. What a member has in
    common with all others of its key is counted at once, from lists of the members that hold each shingle."""
    with np.errstate(over="ignore"):
        mixed = np.repeat(keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), counts)
    mixed ^= shingles.view(np.uint64)
    order = np.argsort(mixed, kind="stable").astype(np.int32)
    mixed = mixed[order]
    new = np.concatenate(([True], mixed[1:] != mixed[:-1])) if len(order) else np.zeros(0, bool)
    del mixed
    starts = np.flatnonzero(new)
    times = np.diff(np.concatenate((starts, [len(order)])))
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    holders = np.repeat(np.arange(len(keys), dtype=np.int32), counts)[order]
    del order, new
    ends, label, out = np.cumsum(counts), np.arange(len(keys)), []
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for q in range(low, high):
            if not left[q] or high - low == 1 or (label[low:high] == label[q]).all():
                continue
            own = which[ends[q] - counts[q] : ends[q]]
            common, step = np.zeros(high - low, np.int64), max(1, AT_ONCE // (high - low))
            for k in range(0, len(own), step):
                n = times[own[k : k + step]]
                at = np.repeat(starts[own[k : k + step]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common += np.bincount(holders[at] - low, minlength=high - low)
            near = right[low:high] & (common * 9 >= (counts[q] + counts[low:high]) * 4)  # 5 x common >= 4 x union
            near[q - low] = False
            hits = low + np.flatnonzero(near)
            while len(hits := hits[label[hits] != label[q]]):
                out.append((q, hits[0]))
                label[low:high][label[low:high] == label[hits[0]]] = label[q]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def verified(sets: DataFrame) -> DataFrame:
    """sets: (class, fp, shingles). Links (a, b) that join what all pairs of a class with a Jaccard similarity of 0.8 or
    more would join. A class of over MEMBERS members or SHINGLES shingles is parted into blocks, and each pair of
    blocks is a task of its own."""
    sized = sets.groupBy("class").agg(F.count("*").alias("members"), F.sum(F.size("shingles")).alias("total"))
    parts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("total") / SHINGLES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = sets.join(sized.select("class", parts.alias("parts")), "class").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("class", F.least("own", "other"), F.greatest("own", "other"))
    keyed = rows.select(key.alias("key"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "fp", "shingles")

    def links(table: pa.Table):
        lists = table.column("shingles").combine_chunks()
        sides = [table.column(c).to_numpy() for c in ("left", "right")]
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = near_members(table.column("key").to_numpy(), *sides, counts, lists.flatten().to_numpy())
        fps = table.column("fp").to_numpy()
        yield fps[a], fps[b]

    return _by_key(keyed, links, lambda batch: 1 + len(batch.column(4).flatten()) // 100)


def copy_links(docs: DataFrame, marked: DataFrame, nodes: DataFrame, size: int, pieces: int, most: int) -> DataFrame:
    """nodes: (fp, wide), one for each set of shingles. The trie join gives classes of candidates, within which all
    pairs are verified."""
    roots = components(fingerprint_links(stored(nodes, "nodes"), pieces, most))
    classes = roots.select(F.col("node").alias("fp"), F.col("root").alias("class"))
    return verified(stored(shingle_sets(docs, marked, classes, size), "shingles"))


def one_of_each(docs: DataFrame, size: int = 5, words: int = WORDS, most: int = MOST) -> DataFrame:
    """docs, same columns: of each component the row of the smallest doc_id stays; of equal ids, one row.

    Texts link when the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are
    fingerprints of `words` words with one piece within the budget and at most `most` differing bits in all; one
    64-bit word within three bits would miss most texts of such a similarity. All pairs of a class of linked candidates
    are verified. Null and empty texts are copies of one another. An empty table gives no rows; very long texts are
    compared whole; extra columns stay, whatever their names."""
    marked = stored(fingerprints(docs, size, words), "fingerprints")
    groups = groups_of(marked, lambda nodes: copy_links(docs, marked, nodes, size, words * BITS // PIECE, most))
    # the first row of each fingerprint, then of each component: exact copies are put together before they are sent
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    each = marked.groupBy("fp").agg(F.min(order).alias("best"))
    best = each.join(groups.select("fp", "component"), "fp").groupBy("component").agg(F.min("best").alias("best"))
    best = best.select(F.struct("best.k1", "best.k2").alias("best"))
    times = marked.groupBy("k1", "k2").count()
    a, b, c = fresh(docs, "k1_of_row"), fresh(docs, "k2_of_row"), fresh(docs, "times_of_row")
    keep = stored(best.select("best.*").join(times, ["k1", "k2"]).toDF(a, b, c), "kept")
    k1, k2 = doc_key(F.col("doc_id"), F.col("text"))
    rows = docs.withColumns({a: k1, b: k2}).join(keep, [a, b])
    once = rows.filter(F.col(c) == 1)
    more = rows.filter(F.col(c) > 1).dropDuplicates([a, b])
    return once.unionByName(more).select(*[F.col(f"`{name}`") for name in docs.columns])


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
