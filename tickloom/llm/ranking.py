"""Quality scores by Bradley-Terry ranking of document features.

Features are shares and ratios of a text's characters, words and lines. In the
fit, labelled documents that were rejected are paired with accepted ones, all of them;
the weights minimise the logistic loss of feature differences, so a score is
a sum of weighted features that ranks. The threshold is the quantile of all labelled
scores at the share of rejected labels; scores are mapped to 0..1 so that this
quantile becomes `cut`.

Null, empty and blank texts have features of their own (no words) and a score.
Rows that repeat score equally; extra columns are ignored. Without labels of both
kinds every document scores 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.labelled import known
from tickloom.llm.texts import Kept, add_columns, as_bytes, map_texts, words_of
from tickloom.operators.statistics import exact_quantiles
from tickloom.session import materialise

PAIRS = 8
#: most Newton steps; they end when a step changes nothing
STEPS = 40
DECAY = 1e-3
#: labelled rows that are paired with each other, and the least of the rarer label among them
CHUNK = 8192
RARER = 64
#: digits of means, spreads and weights: sums in another order must give the same ones
DIGITS = 9

_SYMBOLS = re.compile(rb"[#*$%&|<>{}\[\]~^=\\@_]")
_MARKS = re.compile(rb"[!?]")
_STOPS = re.compile(rb"[.,;:]")
_UPPER = re.compile(rb"[A-Z]|\xc3[\x80-\x96\x98-\x9e]")
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")
_DIGITS = re.compile(rb"[0-9]")
_TAIL = re.compile(rb"[#*$%&|<>!?]{2,}")

NAMES = (
    "no_words", "few_words", "log_words", "bytes_per_word", "long_words", "short_words", "symbols", "symbol_words", "marks",
    "double_tails", "stops", "upper", "upper_words", "digits", "no_letters", "distinct", "same_as_before", "top_word",
    "repeated_lines", "words_per_line", "repeated_triples",
)


def word_facts(words: list[bytes]) -> list[tuple]:
    """Counts that a word adds to its text."""
    made = []
    for w in words:
        letters, upper, symbols = len(_LETTERS.findall(w)), len(_UPPER.findall(w)), len(_SYMBOLS.findall(w))
        made.append(
            (
                len(w), len(w) > 20, len(w) < 3, symbols, symbols > 0, len(_MARKS.findall(w)), _TAIL.search(w) is not None,
                len(_STOPS.findall(w)), upper, letters > 1 and 2 * upper > letters, len(_DIGITS.findall(w)), letters == 0,
            )
        )
    return made


FACTS = Kept(word_facts, 150_000)


def features(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    texts, words = as_bytes(column), words_of(column)
    distinct, edges, sizes, ids = words.distinct, words.edges, words.sizes, words.codes
    of_word = np.array(FACTS.values(distinct), np.float64).reshape(-1, 12)
    rows = np.zeros((len(texts), len(NAMES)))
    rows[:, 0], rows[:, 1], rows[:, 2] = sizes == 0, sizes < 10, np.log1p(sizes)
    full = np.flatnonzero(sizes)
    if not len(full):
        return rows
    n = sizes[full].astype(float)
    sums = np.stack([np.add.reduceat(of_word[ids, k], edges[full]) for k in range(12)], axis=1)
    chars = np.maximum(1, sums[:, 0])
    owner = words.owner
    for k, value in (
        (3, sums[:, 0] / n), (4, sums[:, 1] / n), (5, sums[:, 2] / n), (6, sums[:, 3] / chars), (7, sums[:, 4] / n), (8, sums[:, 5] / n),
        (9, sums[:, 6] / n), (10, sums[:, 7] / n), (11, sums[:, 8] / chars), (12, sums[:, 9] / n), (13, sums[:, 10] / chars), (14, sums[:, 11] / n),
    ):
        rows[full, k] = value
    keys, counts = np.unique(owner * len(distinct) + ids, return_counts=True)
    whose = keys // len(distinct)
    rows[full, 15] = np.bincount(whose, minlength=len(texts))[full] / n
    top = np.zeros(len(texts))
    np.maximum.at(top, whose, counts)
    rows[full, 17] = top[full] / n
    same = np.zeros(len(ids))
    same[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    rows[full, 16] = np.add.reduceat(same, edges[full]) / n
    mix = np.uint64(0x9E3779B97F4A7C15)
    triple = (ids[:-2].astype(np.uint64) * mix + ids[1:-1].astype(np.uint64)) * mix + ids[2:].astype(np.uint64)
    inside = np.flatnonzero(owner[:-2] == owner[2:]) if len(ids) > 2 else np.zeros(0, np.int64)
    if len(inside):
        triple = (triple[inside] * mix + owner[inside].astype(np.uint64)) * mix
        new = np.unique(triple, return_index=True)[1]
        again = np.bincount(owner[inside], minlength=len(texts)) - np.bincount(owner[inside][new], minlength=len(texts))
        rows[full, 20] = again[full] / n
    for k in full.tolist():
        lines = [x for x in texts[k].split(b"\n") if x.strip()]
        rows[k, 18] = 1 - len(set(lines)) / max(1, len(lines))
        rows[k, 19] = np.log1p(sizes[k] / max(1, len(lines)))
    return rows


class Ranker:
    """Feature means and spreads, weights, and the map of margins to 0..1."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, slope: float, shift: float):
        self.mean, self.spread, self.weights, self.slope, self.shift = mean, spread, weights, slope, shift

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((_curved(rows) - self.mean) / self.spread, -5, 5)

    def score(self, rows: np.ndarray) -> np.ndarray:
        margin = (self.scaled(rows) * self.weights).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def _curved(rows: np.ndarray) -> np.ndarray:
    """Square roots, so that small shares of symbols or repeats count."""
    return np.sqrt(np.maximum(rows, 0))


def _of(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, len(NAMES))


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and tl_row, the features of every whole text."""
    work = lambda piece: {"doc_id": piece.column("doc_id"), "tl_row": [r.tobytes() for r in features(piece.column("text"))]}
    return map_texts(docs, "doc_id long, tl_row binary", work)


def with_features(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and tl_row."""
    return add_columns(docs, "tl_row binary", lambda piece: {"tl_row": [r.tobytes() for r in features(piece.column("text"))]})


def _pairs(rows: np.ndarray, quality: np.ndarray, chunk: int, ranker: Ranker) -> np.ndarray:
    """Feature differences of accepted and rejected documents of a chunk, PAIRS for each of the more numerous."""
    accepted, rejected = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    if not len(accepted) or not len(rejected):
        return np.zeros((0, len(NAMES)))
    x, draw = ranker.scaled(rows), np.random.default_rng(7 + chunk)
    many = PAIRS * max(len(accepted), len(rejected))
    better, worse = draw.choice(accepted, many), draw.choice(rejected, many)
    return x[better] - x[worse]


def _summed(table: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """Sum over all batches of a few numbers that `work` makes of each; one row of sums per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = sorted(bytes(r[0]) for r in table.mapInArrow(run, "sums binary").collect())
    return np.sum([np.frombuffer(p, np.float64) for p in parts], axis=0) if parts else np.zeros(width)


def _chunks(labelled: DataFrame, n: int, fewest: int) -> DataFrame:
    """Labelled rows dealt by a hash into chunks of about CHUNK rows, one row each. Rows of the
    rarer label stand in as many chunks as give each chunk RARER of them."""
    chunks = -(-n // CHUNK)
    copies = max(1, min(chunks, -(-RARER * chunks // fewest)))
    place = F.pmod(F.xxhash64("doc_id", "tl_row", F.lit(5)), F.lit(chunks))
    often = F.when(F.col("rare"), F.lit(copies)).otherwise(1)
    dealt = labelled.select("*", F.explode(F.sequence(F.lit(0), often - 1)).alias("copy"))
    dealt = dealt.withColumn("chunk", F.pmod(place + F.col("copy"), F.lit(chunks)))
    return dealt.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tl_row", "quality"))).alias("rows"))


def fit_all(rows: DataFrame, labels: DataFrame, cut: float = 0.3) -> Ranker:
    """Fit on all labelled documents that are not held out; `rows` has doc_id and tl_row.

    Logistic loss on differences between accepted and rejected documents, paired inside
    chunks, by Newton steps: each is a Spark job that sums slope and curvature over all
    pairs. The threshold comes from the exact quantile of all margins."""
    width = len(NAMES)
    held = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "tl_row").join(known(labels), "doc_id").where("quality IN (0, 1)")
    labelled = materialise(held, "labelled")
    n, accepted = labelled.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not accepted or accepted == n:
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 500.0)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        curved = _curved(_of(batch.column("tl_row").to_pylist()))
        return np.concatenate([curved.sum(axis=0), (curved**2).sum(axis=0)])

    first, second = _summed(labelled, moments, 2 * width).reshape(2, width) / n
    spread = np.sqrt(np.maximum(second - first**2, 0))
    ranker = Ranker(np.round(first, DIGITS), np.round(spread, DIGITS) + 1e-3, np.zeros(width), 1.0, 0.0)
    rare = F.col("quality") == (1 if 2 * accepted < n else 0)
    chunks = materialise(_chunks(labelled.withColumn("rare", rare), n, min(accepted, n - accepted)), "chunks")

    def slopes(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(2 + width + width * width)
        for chunk, own in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
            own = own.values
            d = _pairs(_of(own.field("tl_row").to_pylist()), own.field("quality").to_numpy(), chunk, ranker)
            margin = np.clip(d @ ranker.weights, -500, 500)
            miss = 1 / (1 + np.exp(margin))
            bend = (d * (miss * (1 - miss))[:, None]).T @ d
            total += np.concatenate([[len(d), np.logaddexp(0, -margin).sum()], d.T @ miss, bend.ravel()])
        return total

    best, at = np.inf, np.zeros(width)
    for _ in range(STEPS):
        many, loss, *rest = _summed(chunks, slopes, 2 + width + width * width)
        many = max(many, 1)
        loss = loss / many + DECAY / 2 * (ranker.weights**2).sum()
        if loss > best + 1e-12:  # too far: half the step
            ranker.weights = (at + ranker.weights) / 2
            continue
        best, at = loss, ranker.weights
        gradient = DECAY * at - np.array(rest[:width]) / many
        step = np.linalg.solve(np.array(rest[width:]).reshape(width, width) / many + DECAY * np.eye(width), gradient)
        if np.abs(step).max() < 1e-9:
            break
        ranker.weights = at - step
    ranker.weights = np.round(at, DIGITS)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = (ranker.scaled(_of(batch.column("tl_row").to_pylist())) * ranker.weights).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(margin), batch.column("quality")], ["margin", "quality"])

    found = labelled.select("tl_row", "quality").mapInArrow(margins, "margin double, quality int")
    found = found.select("margin", F.when(F.col("quality") == 1, F.col("margin")).alias("good"))
    share = (n - accepted) / n
    quantile = exact_quantiles(found, ["margin", "good"], [share, 0.5])
    border = quantile["margin", share]
    at_cut = np.log(cut / (1 - cut))
    ranker.slope = (np.log(19) - at_cut) / max(quantile["good", 0.5] - border, 1e-6)
    ranker.shift = at_cut - ranker.slope * border
    return ranker


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> Ranker:
    """As `fit_all`, from the documents."""
    return fit_all(materialise(feature_rows(docs), "features"), labels, cut)


def score_of(ranker: Ranker) -> Column:
    """The score of a row with the features tl_row."""

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(_of(rows.tolist())))

    return scored("tl_row")


def with_scores(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """All columns of `docs` and tl_score."""
    return add_columns(docs, "tl_score double", lambda piece: {"tl_score": ranker.score(features(piece.column("text")))})


def quality_scores(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id and score of every whole text."""

    def work(piece: pa.RecordBatch) -> dict:
        return {"doc_id": piece.column("doc_id"), "score": ranker.score(features(piece.column("text")))}

    return map_texts(docs, "doc_id long, score double", work)
