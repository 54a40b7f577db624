"""Quality rules: a calibrated logistic regression on hashed n-grams beside fixed base rules.

Features are hashed word unigrams and bigrams and character 3- and 4-grams of
the words with their borders, as shares of a text. The fit takes a bounded sample of
labelled rows: three in four train the weights, the others calibrate the margins
to probabilities. Scoring runs in Arrow batches against fixed thresholds. Being
linear, a text's margin is a sum over its words of what each word adds, so
frequent words are looked up once.

Null and blank texts have no words and fail the base rule. Rows that repeat get
equal results; extra columns are ignored; an empty table gives no rows. Without
labels of both kinds the method keeps every document that the base rules keep.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.labelled import sample
from tickloom.llm.texts import Kept, as_text, bounds, map_texts, ready_workers, words_of
from tickloom.llm.word_hashes import Runs, mixed

BITS = 18
SAMPLE = 3000
STEPS = 100
DESIGN_BYTES = 1 << 20
KEEP = 0.5
LEAST_WORDS = 10
MOST_REPEATED = 20
REPEAT = 5
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\t\n\v\f\r"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, probability double, kept boolean"
)


def bucket(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> np.uint64(64 - BITS)).astype(np.int64)


def character_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of each 3- and 4-gram of bytes; a word is closed by zero bytes."""
    line = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    starts = np.arange(len(owner))
    three = line[:-2] | line[1:-1] << np.uint64(8) | line[2:] << np.uint64(16)
    four = three[:-1] | line[3:] << np.uint64(24)
    ends = np.repeat(bounds([len(w) + 1 for w in words])[1:], [len(w) + 1 for w in words])
    a, b = starts[starts + 2 <= ends], starts[starts + 3 <= ends]
    a, b = a[a < len(three)], b[b < len(four)]
    return np.concatenate([owner[a], owner[b]]), bucket(np.concatenate([three[a], four[b] | np.uint64(1 << 40)]))


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return bucket(hashes)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each word with the next one."""
    return bucket(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


class Model:
    """Weights of the buckets, intercept, and the calibration of margins."""

    def __init__(self, weights: np.ndarray, base: float, slope: float, shift: float):
        self.weights, self.base, self.slope, self.shift = weights.astype(np.float32), base, slope, shift
        self.key = hashlib.sha256(self.weights.tobytes() + np.array([base, slope, shift]).tobytes()).hexdigest()

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other) -> bool:
        return isinstance(other, Model) and self.key == other.key

    def word_adds(self, words: list[bytes]) -> list[float]:
        """Character part of what each word adds."""
        owner, buckets = character_grams(words)
        total = np.bincount(owner, weights=self.weights[buckets], minlength=len(words))
        return (total / np.maximum(1, np.bincount(owner, minlength=len(words)))).tolist()

    def margins(self, runs: Runs, adds: np.ndarray) -> np.ndarray:
        sizes = np.diff(runs.edges)
        n, total = int(runs.edges[-1]), np.zeros(len(sizes))
        full = np.flatnonzero(sizes)
        if n:
            each = self.weights[word_buckets(runs.hashes)] + adds[runs.words.codes]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pairs = np.where(owner[:-1] == owner[1:], self.weights[pair_buckets(runs.hashes)], 0)
            each[:-1] += pairs
            total[full] = np.add.reduceat(each, runs.edges[full]) / sizes[full]
        return total + self.base

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def design(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the features of each text; their sums are `margins`."""
    words = runs.words
    owner, many = words.owner, len(words.distinct)
    share = 1 / words.sizes[owner]
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    gram_word, gram = character_grams(words.distinct)
    by = np.argsort(gram_word, kind="stable")
    gram_word, gram = gram_word[by], gram[by]
    first = np.searchsorted(gram_word, np.arange(many + 1))
    own, times = np.unique(owner * many + words.codes, return_counts=True)
    row, word = own // max(many, 1), own % max(many, 1)
    grams = np.diff(first)[word]
    inner = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    rows = np.concatenate([owner, owner[inside], np.repeat(row, grams)])
    columns = np.concatenate([word_buckets(runs.hashes), pair_buckets(runs.hashes)[inside], gram[np.repeat(first[word], grams) + inner]])
    values = np.concatenate([share, share[inside], np.repeat(times / words.sizes[row] / np.maximum(1, grams), grams)])
    key, place = np.unique(rows << BITS | columns, return_inverse=True)
    return (key >> BITS).astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32), np.bincount(place, weights=values)


def designs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many texts, a block at a time."""
    made, first, held = [], 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= DESIGN_BYTES or k + 1 == len(texts):
            row, column, value = design(Runs(words_of(pa.array(texts[first : k + 1], pa.binary()))))
            made.append((row + np.int32(first), column, value))
            first, held = k + 1, 0
    return tuple(np.concatenate(x) for x in zip(*made))


def fit(texts: list[bytes], quality: np.ndarray) -> Model:
    """Logistic regression by adaptive gradient steps, then calibration on other rows."""
    blank = Model(np.zeros(1 << BITS), 0.0, 0.0, 500.0)
    train = np.arange(len(texts)) % 4 != 3
    if len({*quality[train]}) < 2:
        return blank
    rows, column, value = designs([t for t, mine in zip(texts, train) if mine])
    wanted = quality[train].astype(float)
    weights, base, total, base_total = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-12), 1e-12
    for _ in range(STEPS):
        margin = np.bincount(rows, weights=weights[column] * value, minlength=len(wanted)) + base
        miss = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - wanted) / len(wanted)
        slope = np.bincount(column, weights=value * miss[rows], minlength=1 << BITS) + 1e-9 * weights
        total, base_total = total + slope**2, base_total + miss.sum() ** 2
        weights, base = weights - slope / np.sqrt(total), base - 0.1 * miss.sum() / np.sqrt(base_total)
    model = Model(weights, base, 1.0, 0.0)
    others = [t for t, own in zip(texts, train) if not own]
    runs = Runs(words_of(pa.array(others, pa.binary())))
    margin = model.margins(runs, np.array(model.word_adds(runs.words.distinct)))
    return Model(weights, base, *calibration(margin, quality[~train]))


def calibration(margin: np.ndarray, quality: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through smoothed targets, by Newton steps."""
    up, down = (quality == 1).sum(), (quality == 0).sum()
    wanted = np.where(quality == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = margin.std() + 1e-9
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b - np.linalg.solve(curve, x.T @ (p - wanted) + 1e-3 * (b - [1.0, 0.0]))
    return float(b[0] / scale), float(b[1])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit in one task on at most `most` labelled documents."""
    ready_workers(docs.sparkSession)

    def run(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (hashlib.sha256(str(r["doc_id"]).encode()).digest(), r["text"] or ""))
        model = fit([(r["text"] or "").encode() for r in rows], np.array([r["quality"] for r in rows], np.int64))
        yield pa.RecordBatch.from_pylist(
            [{"weights": model.weights.tobytes(), "base": model.base, "slope": model.slope, "shift": model.shift}]
        )

    schema = "weights binary, base double, slope double, shift double"
    found = sample(docs, labels, most).repartition(1).mapInArrow(run, schema).collect()
    if not found:
        return Model(np.zeros(1 << BITS), 0.0, 0.0, 500.0)
    row = found[0]
    return Model(np.frombuffer(bytes(row[0]), np.float32), *row[1:])


def repeated_words(runs: Runs) -> np.ndarray:
    """Words of each text in windows of REPEAT words that the text has twice or more."""
    edges, n = runs.edges, int(runs.edges[-1])
    rows = len(edges) - 1
    sizes = np.diff(edges)
    owner = np.repeat(np.arange(rows), sizes)
    at = np.flatnonzero(np.arange(n) + REPEAT <= np.repeat(edges[1:], sizes))
    if not len(at):
        return np.zeros(rows, np.int64)
    keys = mixed(runs.hash(at, at + REPEAT) + owner[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(rows, np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    at = at[twice[place] == keys]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT, -1)
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=rows)


@functools.lru_cache(maxsize=2)
def adds_of(model: Model) -> Kept:
    return Kept(model.word_adds)


def judge(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Base measures, calibrated probability and verdict of every whole text."""

    def work(piece: pa.RecordBatch) -> dict:
        texts = as_text(piece.column("text"))
        raw = [t.encode() for t in texts]
        runs = Runs(words_of(piece.column("text")))
        sizes = np.diff(runs.edges)
        repeated = repeated_words(runs)
        failed = (sizes < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * sizes)
        probability = model.probability(model.margins(runs, np.array(adds_of(model).values(runs.words.distinct))))
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
        return {
            "doc_id": piece.column("doc_id"),
            "n_words": sizes,
            "word_chars": [len(t) - (len(b) - len(b.translate(None, WHITE))) for t, b in zip(texts, raw)],
            "n_symbols": [len(b) - len(b.translate(None, SYMBOLS)) for b in raw],
            "n_dup_lines": [len(own) - len(set(own)) for own in lines],
            "n_repeat_words": repeated,
            "base_failed": failed,
            "probability": probability,
            "kept": ~failed & (probability >= keep),
        }

    return map_texts(docs, SCHEMA, work)
