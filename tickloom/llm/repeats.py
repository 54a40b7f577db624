"""Removal of repeated word runs by compaction of a de Bruijn graph.

A window of `words` consecutive words is an edge. Each window has an anchor, the
least k-mer inside it; consecutive windows with the same anchor form a path, so
the text becomes a chain of paths, about one for every eight words. Equal
windows have equal anchors. If all occurrences of an anchor lie in equal paths,
the path does not branch: it compacts to one row with the source coordinate of
its first occurrence, which settles all its windows. Where an anchor has
different paths, the windows of each different path (its first occurrence only)
are compared one by one. Every other occurrence of a path has all its windows
earlier.

What is shuffled is one row per different path, and the texts, compressed, to meet what was found; a document learns which of its
paths and windows are first, and everything else in it is a repeat. All
aggregates combine before the shuffle, so a passage that many documents share
is one row per slice of text. Runs are compared by 128 bits of hash.

Null and blank texts have no words. Texts shorter than a window lose nothing.
Rows that share id and text are one document and get the same result. Extra
columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tickloom.llm.texts import as_bytes, ready_workers, slices, then_given_back, words_of
from tickloom.llm.word_hashes import Runs, least_in_window
from tickloom.session import materialise

ANCHOR_WORDS = 5
#: bytes of text that are cut into paths together; each needs some forty bytes of memory meanwhile
CUT_BYTES = 1 << 20
#: paths that a task holds, of 32 bytes each, and those it hands on together
HELD_PATHS = 250_000
HANDED_ON = 65_536
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Paths:
    """The paths of a slice: row, start (word of the text), windows, anchor, content."""

    def __init__(self, texts: pa.Array, words: int):
        self.runs = runs = Runs(words_of(texts))
        edges, n = runs.edges, int(runs.edges[-1])
        sizes = np.diff(edges)
        ends = np.repeat(edges[1:], sizes)
        at = np.arange(n)
        width = words - ANCHOR_WORDS + 1
        values = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        inside = np.flatnonzero(at + ANCHOR_WORDS <= ends)
        values[inside] = runs.hash(inside, inside + ANCHOR_WORDS)
        least = least_in_window(values, width)
        window = np.flatnonzero(at + words <= ends)
        anchor = least[window]
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.size = np.diff(np.append(first, len(window)))
        self.at = window[first]
        self.row = np.searchsorted(edges, self.at, side="right") - 1
        self.start = self.at - edges[self.row]
        self.anchor = values[anchor[first]]
        self.content = runs.hash(self.at, self.at + self.size + words - 1)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Of rows (anchor, content, doc, start, size), the first occurrence of each path."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    return rows[new]


def packed(docs: DataFrame) -> DataFrame:
    """The rows with their text compressed, for a shuffle; a null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for piece in slices(batches, CUT_BYTES):
            small = [None if t is None else squeeze(t) for t in piece.column("text").cast(pa.binary()).to_pylist()]
            yield piece.set_column(piece.schema.get_field_index("text"), "text", pa.array(small, pa.binary()))

    fields = [StructField(f.name, BinaryType()) if f.name == "text" else f for f in docs.schema.fields]
    return docs.mapInArrow(then_given_back(run), StructType(fields))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of packed rows with their text again; bounded by the bytes of that."""
    import zstandard

    stretch = zstandard.ZstdDecompressor().decompress
    whole = lambda column: np.array([0 if t is None else zstandard.frame_content_size(t) for t in column.to_pylist()], np.int64)
    for piece in slices(batches, CUT_BYTES, whole):
        texts = [None if t is None else stretch(t) for t in piece.column("text").to_pylist()]
        yield piece.set_column(piece.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))


def paths(docs: DataFrame, words: int) -> DataFrame:
    """Different paths of each run of slices, with their first place there."""
    names = ["anchor", "content", "doc", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in itertools.chain(slices(batches, CUT_BYTES), [None]):
            if piece is not None:
                found = Paths(piece.column("text"), words)
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
                held.append(np.stack([found.anchor.view(np.int64), found.content.view(np.int64), ids[found.row], found.start], axis=1))
                size += len(found.at)
            if size and (piece is None or size >= HELD_PATHS):
                rows = _distinct(held)
                held, size = [], 0
                for a in range(0, len(rows), HANDED_ON):
                    own = rows[a : a + HANDED_ON]
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, k].astype(np.int32) if k == 3 else own[:, k]) for k in range(4)], names)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(then_given_back(run), "anchor long, content long, doc long, start int")


def first_paths(found: DataFrame) -> DataFrame:
    """By document: the starts of paths that occur there first, twice, plus 1 if their anchor branches."""
    dealt = found.repartition("anchor")  # one shuffle for both steps below
    firsts = dealt.groupBy("anchor", "content").agg(F.min(F.struct("doc", "start")).alias("first"))
    same_anchor = Window.partitionBy("anchor")
    marked = firsts.select(
        F.col("first.doc").alias("doc"),
        (F.col("first.start") * 2 + (F.count("*").over(same_anchor) > 1).cast("int")).alias("code"),
    )
    return marked.groupBy("doc").agg(F.collect_list("code").alias("tl_codes"))


def _member(values: np.ndarray, among: list | None) -> np.ndarray:
    return np.isin(values, np.array(among or [], np.int64))


def settle(joined: DataFrame, words: int) -> DataFrame:
    """Per document, runs of windows that repeat for certain (`repeats`) and runs to
    be compared (`asked`) as start, length, ...; and a row for each window to compare."""
    schema = "doc long, repeats array<int>, asked array<int>, anchor long, content long, place int"
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unpacked(batches):
            found = Paths(piece.column("text"), words)
            ids, codes = piece.column("doc_id").to_pylist(), piece.column("tl_codes").to_pylist()
            edges = np.searchsorted(found.row, np.arange(len(ids) + 1))
            docs, repeats, asked, compare = [], [], [], []
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if a == b:
                    continue
                start = found.start[a:b] * 2
                plain, branching = _member(start, codes[k]), _member(start + 1, codes[k])
                pairs = np.stack([found.start[a:b], found.size[a:b]], axis=1)
                again, open_ = pairs[~plain & ~branching].ravel(), pairs[branching].ravel()
                if len(again) or len(open_):
                    docs.append(ids[k])
                    repeats.append(again.tolist())
                    asked.append(open_.tolist())
                    compare.append(np.flatnonzero(branching) + a)
            n = len(docs)
            if not n:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([docs, repeats, asked, *[[None] * n] * 3], kinds)], names)
            path = np.concatenate(compare)
            size = found.size[path]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at, path = np.repeat(found.at[path], size) + inner, np.repeat(path, size)
            columns = [
                pa.array([ids[r] for r in found.row[path]], pa.int64()),
                pa.nulls(len(at), kinds[1]),
                pa.nulls(len(at), kinds[2]),
                pa.array(found.anchor[path].view(np.int64)),
                pa.array(found.runs.hash(at, at + words).view(np.int64)),
                pa.array((found.start[path] + inner).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(then_given_back(run), schema)


def _covered(n: int, words: int, repeats: list | None, asked: list | None, firsts: list | None) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    again = np.zeros(n + 1, np.int64)
    if repeats:
        start, size = np.array(repeats).reshape(-1, 2).T
        np.add.at(again, start, 1)
        np.add.at(again, start + size + words - 1, -1)
    if asked:
        start, size = np.array(asked).reshape(-1, 2).T
        place = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = place[~_member(place, firsts)]
        np.add.at(again, place, 1)
        np.add.at(again, place + words, -1)
    return np.cumsum(again[:-1]) > 0


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without these words, and without the white space before each."""
    out, last = [], 0
    spans = [m.span() for m in _WORD.finditer(text)]
    for a, b in _true_runs(gone):
        out.append(text[last : spans[a - 1][1] if a else 0])
        last = spans[b - 1][1]
    return b"".join([*out, text[last:]])


def _true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def remove_repeats(docs: DataFrame, words: int = 20, with_text: bool = True, with_kept: bool = True) -> DataFrame:
    """All columns of `docs`, then tl_n_words, tl_n_removed, tl_spans (removed runs as
    start, end, ... in words) and, if wanted, tl_kept (kept words joined by one space, as
    UTF-8) and tl_text (the text without its removed words)."""
    ready_workers(docs.sparkSession)
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    firsts = first_paths(paths(keyed, words))
    texts = packed(keyed.where("doc_id IS NOT NULL").select("doc_id", "text"))
    joined = texts.join(firsts.hint("shuffle_hash"), texts["doc_id"] == firsts["doc"], "left").select("doc_id", "text", "tl_codes")
    settled = materialise(settle(joined, words), "repeats")
    compared = settled.where("content IS NOT NULL").groupBy("anchor", "content").agg(F.min(F.struct("doc", "place")).alias("first"))
    new = compared.groupBy(F.col("first.doc").alias("tl_doc")).agg(F.collect_set("first.place").alias("tl_firsts"))
    known = (
        settled.where("content IS NULL")
        .groupBy(F.col("doc").alias("tl_doc"))
        .agg(F.first("repeats").alias("tl_repeats"), F.first("asked").alias("tl_asked"))
    )
    facts = known.join(new, "tl_doc", "left")
    small = packed(keyed)
    full = small.join(facts.hint("shuffle_hash"), small["doc_id"] == facts["tl_doc"], "left").drop("tl_doc")
    kept = docs.columns
    extra = {"tl_n_words": pa.int64(), "tl_n_removed": pa.int64(), "tl_spans": pa.list_(pa.int32())}
    extra |= {"tl_kept": pa.binary()} if with_kept else {}
    extra |= {"tl_text": pa.binary()} if with_text else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unpacked(batches):
            facts = [piece.column(c).to_pylist() for c in ("tl_repeats", "tl_asked", "tl_firsts")]
            rows = []
            for text, *own in zip(as_bytes(piece.column("text")), *facts):
                found = text.split()
                if own[0] or own[1]:
                    gone = _covered(len(found), words, *own)
                    runs = _true_runs(gone)
                    left = (w for w, g in zip(found, gone.tolist()) if not g)
                    spans = [x for r in runs for x in r]
                    texts = [b" ".join(left)] * with_kept + [_cut(text, gone) if with_text else None]
                    rows.append((len(found), int(gone.sum()), spans, *texts))
                else:
                    rows.append((len(found), 0, [], *[b" ".join(found)] * with_kept, text))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), extra.values())]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *made], [*kept, *extra])

    made = "tl_n_words long, tl_n_removed long, tl_spans array<int>" + ", tl_kept binary" * with_kept + ", tl_text binary" * with_text
    out = full.mapInArrow(then_given_back(run), StructType([*keyed.schema.fields, *StructType.fromDDL(made).fields]))
    return out.withColumn("tl_text", F.col("tl_text").cast("string")) if with_text else out
