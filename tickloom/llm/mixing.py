"""Mixing sources to target weights.

The words of each source are summed, every source gets a target, and its
repetition rate is the target over its own words. A document is taken
floor(rate) times, and once more if a number between 0 and 1 made from its id and a
seed lies below the rest of the rate. So a document never occurs more than
`most` times, and two runs agree.

Targets: the weights repeat over the sources in code point order, a null source
last. The mix is `share` times all words. A target above `most` times its
source's words stops there, and what it leaves goes to the others by weight,
until no target is above. In numbers, a target is least(most * words, weight * level);
each round raises the level by what the stopped sources leave.

One draw per document leaves a source with few or very unequal documents far
from its target. Each source therefore tries `draws` seeds in one aggregate and
uses the one whose words come nearest to the target, the first of equals.

Everything is DataFrame work. Texts are read once; after that only ids, sources
and sizes move. Words are summed per source with map-side combine, sources are
numbered by sampled ranges, and a list of sources too long for a broadcast is
joined over salted keys, so no source needs one task for its rows.

Null and blank texts have size 0 and can be taken like others. Rows with equal ids,
null ids included, are drawn alike; each counts. Columns beside doc_id, text and
source are ignored by `mix_plan` and kept by `mixed_documents`, whose added
columns are named by its arguments. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
DRAWS = 64
#: a list of at most this many sources is broadcast; a row is a name and four numbers
BROADCAST_SOURCES = 50_000
SALTS = 32
#: hexadecimal digits of one number in a digest, and numbers per digest
DIGITS, PER_DIGEST = 8, 4


def _sources(sizes: DataFrame) -> DataFrame:
    """source, place (from 0, by code point, null last), words."""
    summed = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    # numbered inside sampled ranges, which are offset by their counts
    held = materialise(summed.orderBy(F.asc_nulls_last("source")).withColumn("id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = held.withColumn("part", part).join(F.broadcast(first), "part")
    return placed.select("source", "words", (F.col("first") + inside).alias("place"))


def _level(sources: DataFrame, share: tuple[int, int], most: int) -> float:
    """The level at which the targets sum to share[0] / share[1] of all words."""
    total, weights = sources.agg(F.sum("words"), F.sum("weight")).first()
    up, down = share
    if not total:
        return 0.0
    if up > most * down:
        raise ValueError("a mix of more than `most` times all words cannot be reached")
    stopped, heavy, level = 0, 0, 0.0
    while heavy < weights:
        level = (up * total - down * most * stopped) / (down * (weights - heavy))
        above = F.col("words") * most < F.col("weight") * F.lit(level)
        now, held = sources.where(above).agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if held <= heavy:
            break
        stopped, heavy = now, held
    return level


def _draw(seed: Column) -> Column:
    """A number of [0, 1) from the document's id and a seed: eight hexadecimal digits of a digest."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.floor(seed / PER_DIGEST).cast("string")))
    digits = F.substr(digest, (seed % PER_DIGEST * DIGITS + 1).cast("int"), F.lit(DIGITS))
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DIGITS))


def _with_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Rows joined with their source's columns; a null source meets the null source."""
    same = rows["source"].eqNullSafe(sources["source"])
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), same).drop(sources["source"])
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    both = dealt["source"].eqNullSafe(salted["source"]) & (dealt["salt"] == salted["salt"])
    return dealt.join(salted, both).drop(salted["source"], dealt["salt"], salted["salt"])


def _sizes(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))


def _rest() -> Column:
    return F.col("rate") - F.floor("rate")


def _copies() -> Column:
    return (F.floor("rate") + F.when(_draw(F.col("seed")) < _rest(), 1).otherwise(0)).cast("int")


def _rates(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int, draws: int) -> tuple[DataFrame, int]:
    """source, words, target, rate and seed, and how many sources there are."""
    order = F.array(*[F.lit(int(w)) for w in weights])
    sources = _sources(sizes).withColumn("weight", F.get(order, (F.col("place") % len(weights)).cast("int")).cast("long"))
    sources = materialise(sources, "weighted")
    n_sources, level = sources.count(), _level(sources, share, most)
    target = F.least((F.col("words") * most).cast("double"), F.col("weight") * F.lit(level))
    rated = sources.select(
        "source", "words", target.alias("target"), F.coalesce(F.try_divide(target, F.col("words")), F.lit(0.0)).alias("rate")
    )
    taken = [F.sum(F.when(_draw(F.lit(k)) < _rest(), F.col("size")).otherwise(0)).alias(f"extra_{k}") for k in range(draws)]
    tried = _with_source(sizes, rated, n_sources).groupBy("source", "words", "target", "rate").agg(*taken)
    off = F.array(*[F.abs(F.col(f"extra_{k}") + F.floor("rate") * F.col("words") - F.col("target")) for k in range(draws)])
    seed = (F.array_position(off, F.array_min(off)) - 1).alias("seed")
    return materialise(tried.select("source", "words", "target", "rate", seed), "rates"), n_sources


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    draws: int = DRAWS,
) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies: how often the mix takes each document."""
    sizes = materialise(_sizes(docs), "sizes")
    rates, n_sources = _rates(sizes, weights, share, most, draws)
    return _with_source(sizes, rates, n_sources).select(
        "doc_id", "size", F.col("words").alias("source_size"), "target", "rate", _copies().alias("copies")
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    draws: int = DRAWS,
    copy: str = "copy",
) -> DataFrame:
    """The mix itself: every document as often as it is taken, and in `copy` which time it is, from 0."""
    if copy.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"{copy} is a column of the documents; name another")
    rates, n_sources = _rates(materialise(_sizes(docs), "sizes"), weights, share, most, draws)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.struct("*").alias("row"))
    taken = _with_source(whole, rates, n_sources).select("row", _copies().alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(copy)).select("row.*", copy)
