"""Language-model scores by Brown classes.

The corpus statistics are word counts over all training texts, kept as a Spark
table. Clustering begins with units: each of the most frequent words by
itself, the others by their ending and length. Exchange clustering moves
units between classes while the class bigram likelihood grows; every round
reads the counts of unit pairs over all training texts in Spark, and a quarter of the
units may move at a time. Then every other word of the training texts, however rare,
moves by itself, to its own best class by its own counts after and before each class, if
that gains more than it takes to tell a class. An eighth of them moves at a time, and the class counts follow; should
the moves together lower the likelihood, words keep the classes of their units. Words that training has not seen take the class of their ending. A text's
probability is the product over its words, and one end, of the class transition
and of the word's emission from its class.

Smoothing: transitions lean on class frequencies with `PULL` pseudo-counts;
each class reserves the share of its words seen once for unseen words, which
count as one event. Both sum to one.

Words frequent enough that at most `HEAD` words are as frequent are looked up
while texts are read; all other words are counted by a join, so nothing that
grows with the corpus is broadcast. Null and blank texts are one end token.
Repeated rows score equally; rows with a null id belong to training; extra
columns are ignored. Without training texts the base score is zero per token
and the score uniform.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.texts import Parts, ready_workers, slices, words_of
from tickloom.session import materialise, scratch_path

CLASSES = 64
OWN_UNITS = 1536
GROUPS = 512
HEAD = 150_000
LONGEST_HEAD = 40
ROUNDS = 12
PULL = 20.0
COUNTED = 400_000

#: bytes of text whose words are counted together, and about the most numbers of words judged together,
#: few enough that their tables stay in a cache
COUNTED_BYTES = 8 << 20
JUDGED = 1 << 11
#: gain in log-likelihood that pays for telling the class of a word which leaves its unit
DESCRIBED = float(np.log(CLASSES - 1))
#: counts up to which logarithms are looked up
SMALL = 32
#: parts of the words that move one after the other
BATCHES = 8
#: kinds of neighbours of a word: classes before it, classes after it, the word itself
ITSELF = 2 * CLASSES

#: unit and class of the end of a text
END = 0


def group_unit(word: bytes) -> int:
    """Unit of a word that has none of its own: its ending and length, hashed."""
    return 1 + OWN_UNITS + zlib.crc32(word[-3:] + bytes([min(len(word) // 4, 5)])) % GROUPS


UNITS = 1 + OWN_UNITS + GROUPS


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for piece in slices(batches):
            words = words_of(piece.column("text"), lower=True)
            for word, n in zip(words.distinct, np.bincount(words.codes, minlength=len(words.distinct)).tolist()):
                held[word] += n
            if len(held) >= COUNTED:
                yield counted(held)
                held = Counter()
        yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int, longest: int = 1 << 30) -> list[tuple[bytes, int]]:
    """The words that are as frequent as some bound, at most `most` of them."""
    usable = counts.where(F.length("word") <= longest)
    steps = usable.groupBy("n").count()
    sizes = steps.groupBy(F.floor(F.log2("n") * 8).alias("band")).agg(F.sum("count").alias("words"), F.min("n").alias("least"))
    total, least = 0, None
    for band in sorted(sizes.collect(), key=lambda b: -b["band"]):
        total += band["words"]
        if total > most:
            break
        least = band["least"]
    if least is None:
        return []
    rows = usable.where(F.col("n") >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))


class Vocabulary:
    """Code of each word: its place among the frequent words, or after them its group unit."""

    def __init__(self, head: list[bytes]):
        self.places = {w: i for i, w in enumerate(head)}
        self.size = len(head)
        #: words with a unit of their own
        self.own = min(self.size, OWN_UNITS)
        own = [1 + i if i < OWN_UNITS else group_unit(w) for i, w in enumerate(head)]
        self.of_codes = np.array([*own, *range(UNITS)], np.int32)

    def codes(self, words: list[bytes]) -> list[int]:
        return [p if p is not None else self.size + group_unit(w) for p, w in zip(map(self.places.get, words), words)]

    def units(self) -> np.ndarray:
        """Unit of each code; the first words have their own, in order."""
        return self.of_codes


def coded(texts: pa.Array, vocabulary: Vocabulary) -> tuple[Parts, np.ndarray]:
    """Words of the texts, and the vocabulary's codes of all words end to end."""
    words = words_of(texts, lower=True)
    return words, np.array(vocabulary.codes(words.distinct), np.int64)[words.codes]


def with_ends(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A leading end, then each text's values followed by an end."""
    n = len(edges) - 1
    out = np.full(1 + len(values) + n, END, values.dtype)
    out[1 + np.arange(len(values)) + np.repeat(np.arange(n), np.diff(edges))] = values
    return out


def unit_pairs(texts: DataFrame, shared) -> DataFrame:
    """before, after, n: counts of neighbouring units over all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        units, held = vocabulary.units(), None
        for piece in slices(batches):
            words, codes = coded(piece.column("text"), vocabulary)
            row = with_ends(units[codes], words.edges).astype(np.int64)
            pairs, times = np.unique(row[:-1] * UNITS + row[1:], return_counts=True)
            held = np.zeros(UNITS * UNITS, np.int32) if held is None else held
            held[pairs] += times.astype(np.int32)
        if held is not None:
            pairs = np.flatnonzero(held)
            columns = [pa.array((pairs // UNITS).astype(np.int32)), pa.array((pairs % UNITS).astype(np.int32)), pa.array(held[pairs].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["before", "after", "n"])

    made = texts.select("text").mapInArrow(run, "before int, after int, n long")
    return made.groupBy("before", "after").agg(F.sum("n").alias("n"))


def fixed_array(values: np.ndarray) -> F.Column:
    """A constant array; one expression, however long."""
    mark = "D" if values.dtype.kind == "f" else ""
    return F.expr(f"array({','.join(f'{x!r}{mark}' for x in values.tolist())})")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(own: int, left: np.ndarray, right: np.ndarray, itself: float, joint: np.ndarray) -> tuple[int, float]:
    """Class to which a unit's move raises the likelihood most, and the gain.
    left and right: its counts after and before each class, itself left out."""
    n = joint.copy()
    n[:, own] -= left
    n[own, :] -= right
    n[own, own] -= itself
    before, after = n.sum(axis=1), n.sum(axis=0)
    total_left, total_right = left.sum() + itself, right.sum() + itself
    # gain of joining class b against standing in no class
    gain = (_xlogx(n + left[:, None]) - _xlogx(n)).sum(axis=0) + (_xlogx(n + right[None, :]) - _xlogx(n)).sum(axis=1)
    corner = np.diag(n)
    gain += _xlogx(corner + left + right + itself) - _xlogx(corner + left) - _xlogx(corner + right) + _xlogx(corner)
    gain -= _xlogx(after + total_left) - _xlogx(after) + _xlogx(before + total_right) - _xlogx(before)
    gain[END] = -np.inf
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def joint_counts(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Class transition counts."""
    of = fixed_array(classes)
    rows = pairs.groupBy(F.get(of, "before").alias("a"), F.get(of, "after").alias("b")).agg(F.sum("n")).collect()
    joint = np.zeros((CLASSES, CLASSES))
    for a, b, n in rows:
        joint[a, b] = n
    return joint


def exchange(pairs: DataFrame, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and class transition counts. `sizes`: count of each unit."""
    order = np.argsort(-sizes[1:], kind="stable") + 1
    classes = np.zeros(UNITS, np.int64)
    classes[order] = 1 + np.arange(UNITS - 1) % (CLASSES - 1)
    seen = joint = joint_counts(pairs, classes)
    best = (-np.inf, classes, joint)
    for turn in range(ROUNDS + 1):
        joint = seen
        fit = likelihood(joint)
        if fit > best[0]:
            best = (fit, classes, joint)
        if turn == ROUNDS:
            break
        moved = dict(moves(pairs, classes, joint, turn % 4))
        if not moved and turn >= 4:
            break
        classes = classes.copy()
        for unit, new in moved.items():
            classes[unit] = new
        seen = joint_counts(pairs, classes)
    return best[1], best[2]


def moves(pairs: DataFrame, classes: np.ndarray, joint: np.ndarray, turn: int) -> list[tuple[int, int]]:
    """New classes of the units of this turn that gain by a move."""
    of = fixed_array(classes)
    mine = lambda c: (F.col(c) % 4 == turn) & (F.col(c) != END)
    inner = pairs.where("before <> after")
    sides = (
        inner.where(mine("after")).select(F.col("after").alias("unit"), F.lit(0).alias("side"), F.get(of, "before").alias("class"), "n")
        .unionByName(inner.where(mine("before")).select(F.col("before").alias("unit"), F.lit(1).alias("side"), F.get(of, "after").alias("class"), "n"))
        .unionByName(pairs.where("before = after").where(mine("after")).select(F.col("after").alias("unit"), F.lit(2).alias("side"), F.lit(0).alias("class"), "n"))
    )
    profiles = sides.groupBy("unit", "side", "class").agg(F.sum("n").alias("n")).groupBy("unit").agg(F.collect_list(F.struct("side", "class", "n")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                counts = np.zeros((3, CLASSES))
                for c in row["counts"]:
                    counts[c["side"], c["class"]] = c["n"]
                own = int(classes[row["unit"]])
                new, gain = best_class(own, counts[0], counts[1], counts[2, 0], joint)
                if new != own and gain > 1e-6:
                    made.append((row["unit"], new))
            units, new = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(new, pa.int32())], ["unit", "new"])

    return [(r[0], r[1]) for r in profiles.mapInArrow(run, "unit int, new int").collect()]


def unit_facts(counts: DataFrame, shared) -> dict[int, tuple[int, int, int]]:
    """Tokens, different words and words seen once of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        units = vocabulary.units()
        total = np.zeros((UNITS, 3), np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            unit = units[np.array(vocabulary.codes(batch.column("word").to_pylist()), np.int64)] if len(n) else n.astype(int)
            np.add.at(total, unit, np.stack([n, np.ones_like(n), n == 1], axis=1))
        columns = [pa.array(np.arange(UNITS)), *(pa.array(total[:, k]) for k in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "tokens", "words", "once"])

    made = counts.mapInArrow(run, "unit long, tokens long, words long, once long").groupBy("unit").agg(F.sum("tokens"), F.sum("words"), F.sum("once"))
    return {r[0]: tuple(r[1:]) for r in made.collect()}


def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Runs of bytes of `values` as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(values)])


def word_profiles(texts: DataFrame, shared, classes: np.ndarray) -> DataFrame:
    """word, entries: how often each word without a unit of its own has each kind of neighbour, a row
    per word of some texts. An entry is a number of 64 bits, its lowest 8 the kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = shared.value, []
        of = classes[vocabulary.units()]
        for piece in slices(batches):
            held.append(piece.column("text"))
            if sum(h.nbytes for h in held) >= COUNTED_BYTES:
                yield counted(vocabulary, of, pa.concat_arrays(held))
                held = []
        if held:
            yield counted(vocabulary, of, pa.concat_arrays(held))

    def counted(vocabulary: Vocabulary, of: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        words, codes = coded(texts, vocabulary)
        path = with_ends(of[codes], words.edges)
        own = with_ends(words.codes + 1, words.edges)  # END is no word
        other = with_ends(codes >= vocabulary.own, words.edges)
        at = np.flatnonzero(other)
        left = np.where(own[at - 1] == own[at], ITSELF, path[at - 1])
        after = at[own[at + 1] != own[at]]  # a pair of itself is counted once
        keys = np.concatenate([(own[at] - 1) * 256 + left, (own[after] - 1) * 256 + CLASSES + path[after + 1]])
        keys, times = np.unique(keys, return_counts=True)
        found, starts = np.unique(keys >> 8, return_index=True)
        packed = binaries((keys & 255 | times << 8).astype("<i8"), 8 * np.append(starts, len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(words.distinct, pa.binary()).take(pa.array(found)), packed], ["word", "entries"])

    return texts.select("text").mapInArrow(run, "word binary, entries binary")


class Rises:
    """x log x of the class counts, and of these with small numbers added or taken, looked up."""

    def __init__(self, joint: np.ndarray):
        small = np.arange(SMALL + 1)[:, None, None]
        self.joint, self.sums = joint, (joint.sum(axis=1), joint.sum(axis=0))
        #: for n and a class: what n neighbours of it add to each class, with the class before and after
        self.steps = tuple(_xlogx(t + small) - _xlogx(t) for t in (joint, joint.T))
        self.plain = tuple(_xlogx(s) for s in self.sums)
        self.more = tuple(_xlogx(s + small[:, 0]) for s in self.sums)

    def cells(self, flip: int, near: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What `times` neighbours of class `near` add to each class, if they are not counted at class `at`, another one."""
        table, rows = self.joint.T if flip else self.joint, np.arange(len(near))
        out = self.steps[flip][np.minimum(times, SMALL).astype(int), near]
        large = np.flatnonzero(times > SMALL)
        if len(large):
            cells, more = table[near[large]], times[large][:, None]
            out[large] = _xlogx(cells + more) - _xlogx(cells)
        here = table[near, at]
        out[rows, at] = _xlogx(here) - _xlogx(here - times)
        return out

    def margins(self, side: int, taken: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x log x of the sums of a side, `taken` from them, with and without `total`."""
        with_it = self.more[side][np.minimum(total, SMALL).astype(int)]
        without = np.repeat(self.plain[side][None], len(total), axis=0)
        changed = (taken != 0) | (total > SMALL)[:, None]
        who, at = np.nonzero(changed)
        left = self.sums[side][at] - taken[who, at]
        with_it[who, at], without[who, at] = _xlogx(left + total[who]), _xlogx(left)
        return with_it, without


def best_classes(
    own: np.ndarray, word: np.ndarray, kind: np.ndarray, n: np.ndarray, joint: np.ndarray, rises: Rises | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """As `best_class` for many words, from their counts that are not zero: n neighbours of `kind` of each `word`.
    Most counts are small and touch few classes: their logarithms are looked up in `rises`, of the same `joint`."""
    rises = rises or Rises(joint)
    counts = np.zeros((len(own), ITSELF + 1))
    counts[word, kind] = n
    left, right, itself = counts[:, :CLASSES], counts[:, CLASSES:ITSELF], counts[:, ITSELF]
    rows = np.arange(len(own))
    totals = left.sum(axis=1) + itself, right.sum(axis=1) + itself
    gain = np.zeros((len(own), CLASSES))
    for flip, (mine, other, table) in enumerate(((left, right, joint), (right, left, joint.T))):
        who, near = np.nonzero(mine)
        if not len(who):
            continue
        times, at = mine[who, near], own[who]
        made = rises.cells(flip, near, at, times)
        same = np.flatnonzero(near == at)
        if len(same):
            cells, more, mid = table[near[same]], times[same][:, None], at[same]
            cells[np.arange(len(same)), mid] -= times[same]
            cells -= other[who[same]]
            cells[np.arange(len(same)), mid] -= itself[who[same]]
            made[same] = _xlogx(cells + more) - _xlogx(cells)
        found, starts = np.unique(who, return_index=True)
        gain[found] += np.add.reduceat(made, starts, axis=0)
    # the corner of a class that is no neighbour does not change
    who, at = np.nonzero((left != 0) | (right != 0) | (itself != 0)[:, None])
    corner, before, after, both = joint[at, at], left[who, at], right[who, at], itself[who]
    corner = corner - np.where(at == own[who], before + after + both, 0)
    both = before + after + both
    gain[who, at] += _xlogx(corner + both) - _xlogx(corner + before) - _xlogx(corner + after) + _xlogx(corner)
    taken = right.copy(), left.copy()
    taken[0][rows, own] += totals[0]
    taken[1][rows, own] += totals[1]
    (more_after, after), (more_before, before) = rises.margins(1, taken[0], totals[0]), rises.margins(0, taken[1], totals[1])
    gain -= more_after - after + more_before - before
    gain[:, END] = -np.inf
    best = gain.argmax(axis=1)
    return best, gain[rows, best] - gain[rows, own]


def whole_profiles(profiles: DataFrame, shared, classes: np.ndarray) -> DataFrame:
    """word, n, class of its unit, entries over all texts."""

    def added(words: pa.Array, entries: pa.Array) -> pa.RecordBatch:
        vocabulary = shared.value
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = classes[vocabulary.units()[np.array(vocabulary.codes(distinct), np.int64)]]
        word, kind, n = entries_of(entries)
        keys, place = np.unique(encoded.indices.to_numpy().astype(np.int64)[word] * 256 + kind, return_inverse=True)
        n, kind = np.bincount(place, weights=n).astype(np.int64), keys & 255
        # wherever a word stands, it has one neighbour before it
        total = np.bincount(keys >> 8, weights=np.where((kind < CLASSES) | (kind == ITSELF), n, 0), minlength=len(distinct)).astype(np.int64)
        packed = binaries((kind | n << 8).astype("<i8"), 8 * np.searchsorted(keys >> 8, np.arange(len(distinct) + 1)))
        columns = [encoded.dictionary, pa.array(total), pa.array(own.astype(np.int32)), packed]
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "class", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, entries = pa.array([], pa.binary()), pa.array([], pa.binary())
        for batch in batches:
            words = pa.concat_arrays([words, batch.column("word")])
            entries = pa.concat_arrays([entries, batch.column("entries")])
            # rows of a word stand together; the last word may go on in the next batch
            cut = pc.index(words, words[-1]).as_py() if len(words) else 0
            if cut:
                yield added(words[:cut], entries[:cut])
                words, entries = words[cut:], entries[cut:]
        if len(words):
            yield added(words, entries)

    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return profiles.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, class int, entries binary")


def entries_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind and number of each entry."""
    packed = np.frombuffer(b"".join(column.to_numpy(zero_copy_only=False).tolist()), "<i8")
    return np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy() // 8), packed & 255, packed >> 8


def word_moves(whole: DataFrame, joint: np.ndarray) -> DataFrame:
    """word, n and best class of each word; and rows without a word, how the class counts `at` change by n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, rises = np.zeros((CLASSES, CLASSES), np.int64), Rises(joint)
        for batch in batches:
            word, kind, n = entries_of(batch.column("entries"))
            own = batch.column("class").to_numpy()
            starts = np.searchsorted(word, np.arange(len(own) + 1))
            blocks = (starts[:-1] + 4 * np.arange(len(own))) // JUDGED
            edges = [*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(own)]
            new = own.copy()
            for a, b in zip(edges, edges[1:]):
                cut = slice(starts[a], starts[b])
                best, gain = best_classes(own[a:b], word[cut] - a, kind[cut], n[cut], joint, rises)
                new[a:b] = np.where(gain > DESCRIBED, best, own[a:b])
            side = kind // CLASSES
            for sign, of in ((-1, own[word]), (1, new[word])):
                a = np.where(side == 0, kind, of)
                b = np.where(side == 1, kind - CLASSES, of)
                np.add.at(change, (a, b), sign * n)
            columns = [batch.column("word"), batch.column("n"), pa.array(new.astype(np.int32)), pa.nulls(len(own), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)
        at = np.flatnonzero(change)
        columns = [pa.nulls(len(at), pa.binary()), pa.array(change.ravel()[at]), pa.nulls(len(at), pa.int32()), pa.array(at.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["word", "n", "class", "at"]
    return whole.select("word", "n", "class", "entries").mapInArrow(run, "word binary, n long, class int, at int")


def word_classes(training: DataFrame, counts: DataFrame, shared, classes: np.ndarray, joint: np.ndarray) -> DataFrame:
    """word, n, class of every word: those without a unit of their own move by themselves, a part after the other."""
    spark = training.sparkSession
    whole, path = whole_profiles(word_profiles(training, shared, classes), shared, classes), scratch_path(spark, "profiles")
    whole.withColumn("batch", F.pmod(F.xxhash64("word"), F.lit(BATCHES)).cast("int")).write.partitionBy("batch").parquet(path)
    whole = spark.read.schema("word binary, n long, class int, entries binary, batch int").parquet(path)
    table = unit_classes(counts, shared, classes, own=True)
    for batch in range(BATCHES):
        moved = materialise(word_moves(whole.where(F.col("batch") == batch), joint), "moves")
        joint = joint.copy()
        for at, change in moved.where("word IS NULL").groupBy("at").agg(F.sum("n")).collect():
            joint[at // CLASSES, at % CLASSES] += change
        joint = np.maximum(joint, 0)
        table = table.unionByName(moved.where("word IS NOT NULL").select("word", "n", "class"))
    return table


def unit_classes(counts: DataFrame, shared, classes: np.ndarray, own: bool = False) -> DataFrame:
    """word, n, class of every word, or of those with a unit of their own: the class of its unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        of = classes[vocabulary.units()].astype(np.int32)
        for batch in batches:
            codes = np.array(vocabulary.codes(batch.column("word").to_pylist()), np.int64)
            made = pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(of[codes])], ["word", "n", "class"])
            yield made.filter(pa.array(codes < vocabulary.own)) if own else made

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, class int")


def likelihood(joint: np.ndarray) -> float:
    """What the class transitions add to the log-likelihood."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=0)).sum() - _xlogx(joint.sum(axis=1)).sum())


def transitions(joint: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class after each class."""
    after = joint.sum(axis=0)
    common = (after + 1) / (after.sum() + CLASSES)
    return np.log10((joint + PULL * common) / (joint.sum(axis=1)[:, None] + PULL))


class ClassModel:
    """Everything that scoring looks up; its size is fixed by HEAD, UNITS and CLASSES.
    `of` and `per_class`: class of each code, and counts of each class, where words have left their units."""

    def __init__(
        self, vocabulary: Vocabulary, head: np.ndarray, classes: np.ndarray, joint: np.ndarray, facts: dict, tokens: int, distinct: int,
        of: np.ndarray | None = None, per_class: np.ndarray | None = None,
    ):
        self.vocabulary, self.tokens, self.distinct = vocabulary, tokens, distinct
        self.classes = classes[vocabulary.units()] if of is None else of
        if per_class is None:
            per_class = np.zeros((CLASSES, 3))
            for unit, counts in facts.items():
                per_class[classes[unit]] += counts
        per_class[END] = (0, 0, 0)
        size, once = per_class[:, 0], per_class[:, 2]
        #: share of a class kept for unseen words; a class without words has nothing else
        self.unseen = np.where(size > 0, (once + 0.5) / (size + 1), 1.0)
        self.size = size
        self.moves = transitions(joint)
        c = head.astype(float)
        of = self.classes[: len(head)]
        self.base = np.log10((c + 1) / (tokens + distinct + 1))
        self.emits = np.log10(np.maximum((1 - self.unseen[of]) * c / np.maximum(size[of], 1), 1e-300))


def scored(docs: DataFrame, shared, ends: int) -> DataFrame:
    """A row per text with what needs no join, its path of classes among it, and a row per place of an other word."""
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, path binary, word binary, class int, place long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        known = model.vocabulary.size
        row = TaskContext.get().partitionId() << 40
        end_base = np.log10((ends + 1) / (model.tokens + model.distinct + 1))
        for piece in slices(batches):
            words, codes = coded(piece.column("text"), model.vocabulary)
            n, sizes, edges, owner = piece.num_rows, words.sizes, words.edges, words.owner
            head = codes < known
            mine, who = codes[head], owner[head]
            score = np.bincount(who, weights=model.emits[mine], minlength=n)
            base = np.bincount(who, weights=model.base[mine], minlength=n) + end_base
            seen = np.bincount(who, minlength=n) + (ends > 0)
            ids = piece.column("doc_id")
            rows = np.arange(row, row + n)
            row += n
            path = binaries(model.classes[codes].astype(np.uint8), edges)
            columns = [rows, ids, sizes + 1, seen, base, score, path, *(pa.nulls(n, k) for k in kinds[7:])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names)
            rest = np.flatnonzero(~head)
            if len(rest):
                word = pa.array(words.distinct, pa.binary()).take(pa.array(words.codes[rest]))
                kind, place = model.classes[codes[rest]].astype(np.int32), rest - edges[owner[rest]]
                columns = [rows[owner[rest]], *(pa.nulls(len(rest), k) for k in kinds[1:7]), word, kind, place]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def paths_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and where each row's begin."""
    edges = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)])
    return np.frombuffer(b"".join(column.to_numpy(zero_copy_only=False).tolist()), np.uint8).copy(), edges


def with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths into which the classes of the words in `places` (place * CLASSES + class) are set."""
    for batch in batches:
        path, edges = paths_of(batch.column("path"))
        lists = batch.column("places")
        spots, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        path[np.repeat(edges[:-1], sizes) + spots // CLASSES] = spots % CLASSES
        keep = [n for n in batch.schema.names if n not in ("path", "places")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), binaries(path, edges)], [*keep, "path"])


def path_counts(paths: DataFrame) -> np.ndarray:
    """Class transition counts of whole paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            row = with_ends(*paths_of(batch.column("path"))).astype(np.int64)
            held += np.bincount(row[:-1] * CLASSES + row[1:], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["at", "n"])

    joint = np.zeros(CLASSES * CLASSES)
    for at, n in paths.select("path").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        joint[at] = n
    return joint.reshape(CLASSES, CLASSES)


def with_moves(paths: DataFrame, moves: np.ndarray) -> DataFrame:
    """The rows of `paths` with the transitions of their path in their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, edges = paths_of(batch.column("path"))
            row = with_ends(path, edges)
            steps = np.append(0.0, moves[row[:-1], row[1:]].cumsum())
            stops = edges + np.arange(batch.num_rows + 1)
            score = batch.column("score").to_numpy() + steps[stops[1:]] - steps[stops[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["path", "score"]).columns, pa.array(score)], names)

    names = [n for n in paths.columns if n not in ("path", "score")] + ["score"]
    return paths.mapInArrow(run, ", ".join(f"{n} {dict(paths.dtypes)[n]}" for n in names))


def whole_paths(texts: DataFrame, table: DataFrame, model: ClassModel, ends: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base, score without transitions, and the path of classes of every text.
    `table`: word, n, class of all words of the training texts."""
    parts = materialise(scored(texts, texts.sparkSession.sparkContext.broadcast(model), ends), "scores")
    rest = parts.where("word IS NOT NULL").select("row", "word", F.col("class").alias("unit_class"), "place")
    unseen, weight = fixed_array(model.unseen), fixed_array(np.maximum(model.size, 1.0))
    total = F.lit(float(model.tokens + model.distinct + 1))
    kind = F.coalesce("class", "unit_class")
    emitted = F.when(F.col("n").isNull(), F.log10(F.get(unseen, kind))).otherwise(
        F.log10((1 - F.get(unseen, kind)) * F.col("n") / F.get(weight, kind))
    )
    joined = rest.join(table, "word", "left").groupBy("row").agg(
        F.sum(emitted).alias("more_score"),
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / total)).alias("more_base"),
        F.count("n").alias("more_known"),
        F.collect_list(F.col("place") * CLASSES + kind).alias("places"),
    )
    whole = parts.where("word IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "score", "path")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    rows = whole.join(joined, "row", "left").select(
        "doc_id",
        "n_tokens",
        plus("n_known", "more_known"),
        plus("base", "more_base"),
        plus("score", "more_score"),
        "path",
        F.coalesce("places", F.expr("CAST(array() AS array<bigint>)")).alias("places"),
    )
    return rows.mapInArrow(with_places, "doc_id long, n_tokens long, n_known long, base double, score double, path binary")


def class_scores(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    whole text; learns from the texts where `held_out` is not true."""
    spark = docs.sparkSession
    ready_workers(spark)
    share = spark.sparkContext.broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_held = F.coalesce(held_out, F.lit(False))
    training = texts.where(~is_held)
    counts = materialise(word_counts(training), "words")
    facts = counts.agg(F.sum("n"), F.count("*")).first()
    ends = training.count()
    tokens, distinct = (facts[0] or 0) + ends, facts[1] + (ends > 0)
    head = most_frequent(counts, HEAD, LONGEST_HEAD)
    vocabulary = Vocabulary([w for w, _ in head])
    shared = share(vocabulary)
    pairs = materialise(unit_pairs(training, shared), "pairs")
    units = unit_facts(counts, shared)
    sizes = np.array([units.get(u, (0,))[0] for u in range(UNITS)])
    classes, joint = exchange(pairs, sizes)
    own = materialise(word_classes(training, counts, shared, classes, joint), "classes")
    for table in (own, unit_classes(counts, shared, classes)):
        of = classes[vocabulary.units()]
        if head:
            for word, kind in table.where((F.col("n") >= head[-1][1]) & (F.length("word") <= LONGEST_HEAD)).select("word", "class").collect():
                of[vocabulary.places[bytes(word)]] = kind
        per_class = np.zeros((CLASSES, 3))
        for kind, *numbers in table.groupBy("class").agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long"))).collect():
            per_class[kind] = numbers
        model = ClassModel(vocabulary, np.array([n for _, n in head]), classes, joint, units, tokens, distinct, of, per_class)
        paths = materialise(whole_paths(texts, table, model, ends), "paths")
        found = path_counts(paths.where(~is_held))
        if likelihood(found) >= likelihood(joint) - 1e-6:
            break
    return with_moves(paths, transitions(found)).select(
        "doc_id",
        is_held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
