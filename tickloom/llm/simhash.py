"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: every bit is set if more than half of a text's shingle hashes set
it. Equal fingerprints are one node. A first level of the index factors masked
bit patterns: nodes that agree on all bits of a mask share a group. With up to 4
differing bits, two of six bit blocks stay equal, so the 15 masks of two blocks
miss no link. Inside a group the codes lie in Gray-rank order, under a tree
whose nodes hold the bits that all their codes share; differences with these
shared patterns add up on the way down, and whole nodes are left out once they
exceed the limit. A large group is dealt over pairs of blocks, each a task of
bounded size. Each group gives a spanning forest of its links, never all pairs,
and components are contracted in Spark.

Null, empty and blank texts have fingerprint zero and link like any other. Rows
that repeat share their component. Rows with a null id get a fingerprint and
the component of their fingerprint, but do not link others. An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.texts import as_bytes, give_back, map_texts, slices
from tickloom.llm.word_hashes import mixed
from tickloom.session import materialise

SEED = 42
BLOCK = 4096
BRANCH = 16
SMALL = 48
#: most documents, and about the most shingle hashes, of a block that is compared exactly
SET_ROWS = 1024
SET_VALUES = 2_000_000
#: masks of the first round; all others link only what it has not connected
FIRST_MASKS = 8
#: counters of shingles, by the low bits of their hash
COUNTERS = 1 << 18
#: sets that share a rare shingle are counted in pairs up to this many, more of them are one family
PAIRED = 256

_MIX = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle; a text of fewer words is one shingle."""
    import xxhash

    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    line = b" ".join(own)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    reach = min(words, len(own)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[reach:])], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes of a text's fingerprint. Lane 0 uses the hash of each
    shingle, further lanes mixes of it."""
    out = []
    for lane in range(lanes):
        h = hashes if lane == 0 else mixed(hashes + np.uint64(_MIX * lane % 2**64))
        count = np.zeros(64, np.int64)
        for a in range(0, len(h), 4096):
            bits = np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * count > len(h), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """doc_id, l0, l1, ... of every row's whole text."""

    def work(piece: pa.RecordBatch) -> dict:
        made = [fingerprint(shingle_hashes(t, words), lanes) for t in as_bytes(piece.column("text"))]
        return {"doc_id": piece.column("doc_id")} | {f"l{k}": [m[k] for m in made] for k in range(lanes)}

    return map_texts(docs, ", ".join(["doc_id long", *(f"l{k} long" for k in range(lanes))]), work)


def block_masks(bits: int) -> list[list[int]]:
    """Masks of two out of bits + 2 blocks of a 64-bit code: complete up to `bits` differences."""
    edges = np.linspace(0, 64, bits + 3).astype(int)
    blocks = [(1 << int(b)) - (1 << int(a)) for a, b in zip(edges, edges[1:])]
    return [[a | b] for a, b in itertools.combinations(blocks, 2)]


def sampled_masks(lanes: int, width: int, number: int) -> list[list[int]]:
    """Masks of `width` seeded bits each, for limits that blocks can't guarantee."""
    masks = []
    for k in range(number):
        chosen = np.random.default_rng(k).choice(64 * lanes, width, replace=False)
        masks.append([sum(1 << int(c % 64) for c in chosen if c // 64 == lane) for lane in range(lanes)])
    return masks


def mask_number(width: int, size: int, bits: int, least: float, recall: float) -> int:
    """Fewest sampled masks of `width` bits under which two codes of `size` bits of sets of Jaccard
    similarity `least`, which differ in at most `bits` bits, share a key with probability `recall`
    (or as nearly as the limit on bits allows)."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    differ = np.arange(min(bits, size - width) + 1)
    log = np.vectorize(math.lgamma)
    chance = np.exp(log(size + 1.0) - log(differ + 1.0) - log(size - differ + 1.0) + differ * math.log(p) + (size - differ) * math.log1p(-p))
    miss = 1 - np.prod([(size - differ - i) / (size - i) for i in range(width)], axis=0)
    number, goal = 1, min(recall, float(chance.sum()) - 1e-4)
    while (chance * (1 - miss**number)).sum() < goal:
        number += 1
    return number


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def gray_rank(column: F.Column) -> F.Column:
    """Place of a code in the Gray sequence, in an order that signed longs keep."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each of n rows reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label[label[label]]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b are added."""
    return lowest(len(label), label[a], label[b])[label]


class GrayTree:
    """Upper nodes over codes in Gray order: shared bits and their pattern."""

    def __init__(self, codes: np.ndarray):
        self.levels = []  # from the leaves' parents up
        ones, zeros = codes, ~codes
        while len(ones) > 1:
            starts = np.arange(0, len(ones), BRANCH)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones))
        self.codes = codes

    def near(self, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of asked, row of codes) that differ in at most `bits` bits."""
        top = len(self.levels)
        who = np.arange(len(asked))
        node = np.zeros(len(asked), np.int64)
        for level in range(top - 1, -2, -1):
            if level < 0:
                different = asked[who] ^ self.codes[node]
            else:
                mask, pattern = self.levels[level]
                different = (asked[who] ^ pattern[node]) & mask[node]
            near = np.bitwise_count(different).sum(axis=1, dtype=np.int32) <= bits
            who, node = who[near], node[near]
            if level >= 0:
                below = len(self.levels[level - 1][0]) if level else len(self.codes)
                who = np.repeat(who, BRANCH)
                node = (node[:, None] * BRANCH + np.arange(BRANCH)).ravel()
                inside = node < below
                who, node = who[inside], node[inside]
        return who, node


def group_links(codes: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """Least linked row of each row; groups are runs of equal values in `group`."""
    n = len(codes)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(np.append(starts, n))
    of_size = np.repeat(sizes, sizes)
    left, right = [], []
    for lag in range(1, min(SMALL, int(sizes.max()))):
        at = np.flatnonzero((of_size[:-lag] <= SMALL) & (group[:-lag] == group[lag:]))
        at = at[np.bitwise_count(codes[at] ^ codes[at + lag]).sum(axis=1, dtype=np.int32) <= bits]
        left.append(at)
        right.append(at + lag)
    label = lowest(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)
    for k in np.flatnonzero(sizes > SMALL):
        a, b = starts[k], starts[k] + sizes[k]
        label[a:b] = large_group(codes[a:b], bits) + a
    return label


def large_group(codes: np.ndarray, bits: int) -> np.ndarray:
    """Least linked row of each row of one group, in Gray order. Rows that are in one
    component already are compared with the rest of the group only."""
    tree, own, todo, step = GrayTree(codes), np.arange(len(codes)), np.arange(len(codes)), 16
    while len(todo):
        mine = own[todo] == own[todo[0]]
        if mine.sum() >= SMALL:
            asked = todo[mine][:step]
            rest = np.flatnonzero(own != own[todo[0]])
            if not len(rest):
                break
            who, found = GrayTree(codes[rest]).near(codes[asked], bits)
            found = rest[found]
        else:
            asked = todo[:step]
            who, found = tree.near(codes[asked], bits)
        who = asked[who]
        differ = own[who] != own[found]
        if differ.any():
            own = merge_labels(own, who[differ], found[differ])
        todo = np.setdiff1d(todo, asked, assume_unique=True)
        step = min(2 * step, 256)
    return own


def linked(nodes: DataFrame, lanes: int, bits: int, masks: list[list[int]]) -> DataFrame:
    """Links (a, b) of nodes (node, l0, ...): a spanning forest for each group of each mask."""
    codes = [f"l{k}" for k in range(lanes)]
    key = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(m).alias("mask"),
                    F.xxhash64(*(F.col(c).bitwiseAND(F.lit(signed(x)).cast("long")) for c, x in zip(codes, mask))).alias("key"),
                )
                for m, mask in enumerate(masks)
            )
        )
    )
    keyed = nodes.select("node", *codes, key.alias("k")).select("node", *codes, "k.mask", "k.key")
    sizes = keyed.groupBy("mask", "key").count().where("count > 1")
    dealt = _dealt(keyed.join(sizes, ["mask", "key"]), ["mask", "key"])
    return _searched(dealt.select("node", *codes, "task", gray_rank(F.col("l0")).alias("rank")), codes, bits)


def linked_long(nodes: DataFrame, lanes: int, bits: int, masks: list[list[int]]) -> DataFrame:
    """As `linked`, for long codes and many masks. Only node and key are shuffled for every mask,
    once for counting and joining; codes go to the nodes whose key occurs twice. Links are between
    the `part` of nodes (node, part, l0, ...); nodes of one part are connected already."""
    codes = [f"l{k}" for k in range(lanes)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                own = [part.column(c).to_numpy().view(np.uint64) for c in codes]
                for m, mask in enumerate(masks):
                    key = np.full(part.num_rows, m, np.uint64)
                    for code, x in zip(own, mask):
                        key = mixed(key ^ (code & np.uint64(x))) if x else key
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(mixed(key).view(np.int64))], ["node", "key"])

    keyed = nodes.select("node", *codes).mapInArrow(keys, "node long, key long")
    keyed = keyed.where("node IS NOT NULL AND key IS NOT NULL").repartition("key")
    # nodes are unique; by their ids, both sides of the join read one shuffle
    sizes = keyed.groupBy("key").agg(F.count("*").alias("count"), F.min("node").alias("low"), F.max("node").alias("high"))
    sizes = sizes.where("low < high").select("key", "count")
    dealt = _dealt(keyed.join(sizes, "key"), ["key"]).select("node", "task")
    # a node of many groups asks for its code once per group; nodes are few beside groups, and unique
    full = dealt.join(nodes.select("node", "part", *codes), "node")
    return _searched(full.select(F.col("part").alias("node"), *codes, "task", gray_rank(F.col("l0")).alias("rank")), codes, bits)


def code_families(nodes: DataFrame, lanes: int, bits: int, masks: list[list[int]]) -> DataFrame:
    """Columns a, component of every node with a link under any mask, as from all links at once. The nodes
    of a large group are linked under a few masks; under the others only what these have left apart."""
    alone = F.col("node").alias("part")
    reached = components(linked_long(nodes.select("*", alone), lanes, bits, masks[:FIRST_MASKS]))
    if not masks[FIRST_MASKS:]:
        return reached
    part = F.coalesce("component", "node").alias("part")
    # `once`: linked in the first round, so that a whole group keeps its nodes without further links
    parts = materialise(
        nodes.join(reached, nodes["node"] == reached["a"], "left").select(*nodes.columns, part, F.col("a").isNotNull().alias("once")), "parts"
    )
    more = components(linked_long(parts, lanes, bits, masks[FIRST_MASKS:]))
    return (
        parts.join(more, parts["part"] == more["a"], "left")
        .where("once OR component IS NOT NULL")
        .select(F.col("node").alias("a"), F.coalesce("component", "part").alias("component"))
    )


def _dealt(grouped: DataFrame, key: list[str]) -> DataFrame:
    """Rows of groups with their `count`, dealt over pairs of blocks: the task of each."""
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    pairs = grouped.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return pairs.withColumn("task", F.xxhash64(*key, F.least("block", "other"), F.greatest("block", "other")))


def _searched(dealt: DataFrame, codes: list[str], bits: int) -> DataFrame:
    """Links inside each task of rows (node, codes, task, rank)."""
    names = ["node", *codes, "task"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                new = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
                rows = new if held is None else np.concatenate([held, new])
                if not len(rows):
                    continue
                whole = np.flatnonzero(rows[:, -1] != rows[-1, -1])
                cut = int(whole[-1]) + 1 if len(whole) else 0
                rows, held = rows[:cut], rows[cut:]
            if rows is None or len(rows) < 2:
                continue
            label = group_links(np.ascontiguousarray(rows[:, 1:-1]).view(np.uint64), rows[:, -1], bits)
            # to the least node, which is mostly the same one under all masks
            first = rows[:, 0].copy()
            np.minimum.at(first, label, rows[:, 0])
            moved = np.flatnonzero(first[label] != rows[:, 0])
            if len(moved):
                links = np.unique(np.stack([rows[moved, 0], first[label[moved]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
        give_back()

    parts = dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return dealt.repartition(int(parts), "task").sortWithinPartitions("task", "rank").select(*names).mapInArrow(search, "a long, b long")


def set_prints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """Of every row's set of shingles: doc_id, l0, l1, ..., their number n and a hash `own` of the whole set."""

    def work(piece: pa.RecordBatch) -> dict:
        import xxhash

        sets = [np.unique(shingle_hashes(t, words)) for t in as_bytes(piece.column("text"))]
        made = [fingerprint(s, lanes) for s in sets]
        own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        codes = {f"l{k}": [m[k] for m in made] for k in range(lanes)}
        return {"doc_id": piece.column("doc_id"), "own": own, "n": np.array([len(s) for s in sets], np.int64)} | codes

    return map_texts(docs, ", ".join(["doc_id long, own long, n long", *(f"l{k} long" for k in range(lanes))]), work)


def similar_rows(sets: list[np.ndarray], least: float) -> np.ndarray:
    """A row that each row reaches over pairs of sets with Jaccard similarity `least`
    or more. Each row is compared once with all rows that were not reached before."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    inside = np.zeros(sum(sizes), bool)
    label, unreached = np.arange(n), np.ones(n, bool)
    rows = np.zeros(0, np.int64)
    for root in range(n):
        todo = [root] if unreached[root] else []
        unreached[root] = False
        while todo:
            k = todo.pop()
            left = int(unreached.sum())
            if not left:
                break
            if 2 * left <= len(rows) or not len(rows):
                rows = np.flatnonzero(unreached & (sizes > 0))
                if not len(rows):
                    break
                flat, starts = np.concatenate([ids[r] for r in rows]), np.cumsum(sizes[rows]) - sizes[rows]
            inside[ids[k]] = True
            common = np.add.reduceat(inside[flat], starts, dtype=np.int64)
            inside[ids[k]] = False
            near = rows[unreached[rows] & (common / (sizes[rows] + sizes[k] - common) >= least)]
            unreached[near] = False
            label[near] = root
            todo.extend(near.tolist())
    return label


def verified(docs: DataFrame, families: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) of documents whose sets of shingles have Jaccard similarity `least` or
    more: a spanning forest for each family. `families`: doc_id, family, n (size of
    the set). A large family is dealt over pairs of blocks of bounded number and size."""
    weight = families.groupBy("family").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("count") / SET_ROWS), F.ceil(F.col("n") / SET_VALUES), F.lit(1)).cast("int")
    members = families.select("doc_id", "family").distinct().join(weight.select("family", blocks.alias("blocks")), "family")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id").distinct()
    names = ["node", "own", "task"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            own = [np.unique(shingle_hashes(t, words)).tobytes() for t in as_bytes(piece.column("text"))]
            columns = [piece.column("doc_id"), piece.column("family"), piece.column("blocks"), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "family", "blocks", "own"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in names)))
        for _, group in itertools.groupby(rows, key=lambda row: row[2]):
            nodes, own, _ = zip(*group)
            if len(nodes) > 1:
                label = similar_rows([np.frombuffer(s, np.uint64) for s in own], least)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes, pa.int64()).take(pa.array(label))], ["a", "b"])
        give_back()

    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    dealt = (
        texts.select("doc_id", "text", "family", "blocks")
        .mapInArrow(sets, "node long, family long, blocks int, own binary")
        .select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", "own", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    )
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = dealt.repartition(int(parts), "task").sortWithinPartitions("task").mapInArrow(search, "a long, b long")
    return found.where("a <> b")


def place_of(hashes: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each hash."""
    return (hashes & np.uint64(counters - 1)).astype(np.int64)


def shingle_levels(docs: DataFrame, words: int) -> np.ndarray:
    """How common a shingle is, by the low bits of its hash: 0, or from a count far above the usual one its
    logarithm. One table of bounded size; a wrong level costs time, not a link."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for piece in slices(batches):
            own = [np.unique(shingle_hashes(t, words)) for t in as_bytes(piece.column("text"))]
            if own:
                found += np.bincount(place_of(np.concatenate(own), COUNTERS), minlength=COUNTERS)
        made = [b.tobytes() for b in found.reshape(64, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array(made, pa.binary())], ["block", "counts"])
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["block", "counts"]
        )

    form = "block long, counts binary"
    rows = docs.select("text").mapInArrow(count, form).repartition("block").mapInArrow(add, form).collect()
    counts = np.zeros((64, COUNTERS // 64), np.int64)
    for row in rows:
        counts[row.block] = np.frombuffer(row.counts, np.int64)
    usual = counts.mean()
    level = np.log2(np.maximum(counts, 1)).astype(np.uint8) + np.uint8(1)
    return np.where(counts > usual + 6 * math.sqrt(usual) + 16, level, 0).astype(np.uint8).ravel()


def least_common(n: np.ndarray | int, least: float) -> np.ndarray:
    """Fewest shingles that a set of n has in common with one of similarity `least` or more."""
    return np.ceil(least * n - 1e-6).astype(np.int64)


def rare_shingles(own: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in the order of (level, hash), so many that two sets of similarity `least`
    or more have one of theirs in common: all others together are too few."""
    order = np.argsort(levels[place_of(own, len(levels))], kind="stable")
    return own[order[: len(own) - int(least_common(np.int64(len(own)), least)) + 1]]


def close_sets(docs: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) that join all pairs of nodes (node, part) of different parts whose sets of shingles have Jaccard
    similarity `least` or more. The rare shingles of such sets have some in common, and at least so many that the
    other shingles can make up for the rest. Sets with a rare shingle that more than PAIRED have are linked by it alone."""
    levels = shingle_levels(docs, words)

    def work(piece: pa.RecordBatch) -> dict:
        sets = [np.unique(shingle_hashes(t, words)) for t in as_bytes(piece.column("text"))]
        rare = pa.array([rare_shingles(s, levels, least).view(np.int64) for s in sets], pa.list_(pa.int64()))
        return {"doc_id": piece.column("doc_id"), "n": np.array([len(s) for s in sets], np.int64), "rare": rare}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                new = np.stack([batch.column(c).to_numpy() for c in ("key", "part", "node", "n")], axis=1)
                rows = new if held is None else np.concatenate([held, new])
                whole = np.flatnonzero(rows[:, 0] != rows[-1, 0]) if len(rows) else []
                cut = int(whole[-1]) + 1 if len(whole) else 0
                rows, held = rows[:cut], rows[cut:]
            if rows is None or len(rows) < 2:
                continue
            at = np.arange(len(rows))
            for lag in range(1, PAIRED):
                at = at[at + lag < len(rows)]
                at = at[rows[at, 0] == rows[at + lag, 0]]
                if not len(at):
                    break
                a, b = rows[at], rows[at + lag]
                small, large = np.minimum(a[:, 3], b[:, 3]), np.maximum(a[:, 3], b[:, 3])
                near = (a[:, 1] != b[:, 1]) & (small >= least_common(large, least))
                a, b, small, large = a[near, 2], b[near, 2], small[near], large[near]
                both = np.ceil(least / (1 + least) * (small + large) - 1e-6).astype(np.int64)
                need = both - least_common(large, least) + 1
                made = [pa.array(x) for x in (np.maximum(a, b), np.minimum(a, b), need)]
                yield pa.RecordBatch.from_arrays(made, ["a", "b", "need"])
        give_back()

    rare = map_texts(docs, "doc_id long, n long, rare array<long>", work)
    keyed = rare.join(nodes.distinct(), rare["doc_id"] == nodes["node"]).dropDuplicates(["doc_id", "rare"])
    keyed = keyed.select(F.explode("rare").alias("key"), "part", "node", "n")
    keyed = keyed.where("key IS NOT NULL AND part IS NOT NULL AND node IS NOT NULL AND n IS NOT NULL").repartition("key")
    # with all columns in use, both sides of the join read one shuffle
    facts = [F.count("*").alias("count"), F.min("part").alias("low"), F.max("part").alias("high"), F.max("node").alias("last"), F.max("n").alias("most")]
    sizes = keyed.groupBy("key").agg(*facts).where("low < high AND last IS NOT NULL AND most IS NOT NULL")
    shared = materialise(keyed.join(sizes.select("key", "count", "low"), "key"), "shared")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    few = shared.where(F.col("count") <= PAIRED).select("key", "part", "node", "n")
    few = few.repartition(int(parts), "key").sortWithinPartitions("key").mapInArrow(pairs, "a long, b long, need long")
    few = few.groupBy("a", "b").agg(F.count("*").alias("count"), F.max("need").alias("need")).where("count >= need").select("a", "b")
    # to the least part of theirs, which is a node
    many = shared.where(F.col("count") > PAIRED).select(F.col("node").alias("a"), F.col("low").alias("b"))
    return few.unionByName(many).where("a <> b").distinct()


def one_of_each(
    docs: DataFrame, words: int = 5, lanes: int = 8, bits: int = 105, spare: int = 4, recall: float = 0.992, least: float = 0.8
) -> DataFrame:
    """The rows of `docs` that are the first of their group, all columns kept.

    Groups are the components of pairs whose sets of shingles have Jaccard similarity
    `least` or more, by exact comparison inside families. Families come from
    codes: a code of 512 bits estimates the cosine of two texts' shingles: texts that share
    0.8 of theirs differ in 78 bits on average, unrelated ones in 256. Masks of seeded
    bits find such pairs. A mask has `spare` bits more than the number of codes, so
    unrelated codes share few keys at any size, and there are as many masks as find an
    isolated pair of `least` with probability `recall`. The pairs that no mask finds are found by
    the rare shingles of sets that are still apart, so that none is left out. Rows with a null id stay.
    """
    with_id = docs.where("doc_id IS NOT NULL")
    codes = [f"l{k}" for k in range(lanes)]
    prints = materialise(set_prints(with_id, words, lanes), "fingerprints")
    nodes = materialise(prints.groupBy(*codes, "own", "n").agg(F.min("doc_id").alias("node")), "nodes")
    width = max(16, math.ceil(math.log2(nodes.count() + 1)) + spare)
    masks = sampled_masks(lanes, width, mask_number(width, 64 * lanes, bits, least, recall))
    reached = code_families(nodes, lanes, bits, masks)
    families = nodes.join(reached, nodes["node"] == reached["a"]).select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "n")
    links = materialise(verified(with_id, materialise(families, "families"), words, least), "similar")
    known = components(links)
    part = F.coalesce("component", "node").alias("part")
    parts = materialise(nodes.join(known, nodes["node"] == known["a"], "left").select("node", part, "n"), "parts")
    close = components(close_sets(with_id, parts.select("node", "part"), words, least))
    families = parts.join(close, parts["node"] == close["a"]).select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "n")
    more = verified(with_id, materialise(families, "families"), words, least)
    again = components(links.unionByName(more)).where("a <> component")
    first = nodes.select(F.col("node").alias("tl_first")).distinct()
    first = first.join(again, first["tl_first"] == again["a"], "left_anti")
    return with_id.join(first, with_id["doc_id"] == first["tl_first"], "left_semi").unionByName(docs.where("doc_id IS NULL"))


def near_components(
    docs: DataFrame, words: int = 5, bits: int = 4, lanes: int = 1, masks: list[list[int]] | None = None
) -> DataFrame:
    """doc_id, fingerprint lanes l0.., component_id (least id reached) of every row."""
    codes = [f"l{k}" for k in range(lanes)]
    prints = materialise(fingerprints(docs, words, lanes), "fingerprints")
    nodes = materialise(prints.groupBy(*codes).agg(F.min("doc_id").alias("node")), "nodes")
    links = linked(nodes.where("node IS NOT NULL"), lanes, bits, masks or block_masks(bits))
    reached = components(links)
    of_code = nodes.join(reached, nodes["node"] == reached["a"], "left").select(
        *codes, F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(of_code, codes)
