"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each partition tokenizes its documents and packs their pieces best-fit; nearly
full bins are done. The pieces of all other bins go up as counts by length, at
most `capacity` numbers however many rows there are. The counts of all leaves
are packed best-fit as runs of equal bins, and a piece finds its bin by its
length and its rank among all open pieces of that length. No bin closes because
of a number, and no piece is ever dropped.

A text longer than `capacity` becomes pieces of exactly `capacity` tokens, the
first of which may be shorter. Null and empty texts are documents of one end
token. Rows that repeat are packed each; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.byte_tokens import byte_tokenizer
from tickloom.llm.texts import as_text, ready_workers, slices
from tickloom.session import materialise

SLACK = 2
#: rows of an Arrow batch of pieces
CARRIED = 8192
BLOCK = 1 << 17
#: sequences that hold pieces of several leaves are numbered from here, above every piece's number
SHARED = 1 << 62

LEAF = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, node long, rank long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by bin: largest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        if room > size:
            open_by_room[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def settle(sizes: list[int], capacity: int, last: bool) -> tuple[list[list[int]], list[list[int]]]:
    """One best-fit round: bins that are done, and the items of all others grouped by size."""
    bins = best_fit(sizes, capacity)
    if last:
        return bins, []
    done, up = [], {}
    for own in bins:
        if sum(sizes[i] for i in own) >= capacity - SLACK:
            done.append(own)
        else:
            for i in own:
                up.setdefault(sizes[i], []).append(i)
    return done, list(up.values())


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit of counted items, largest first: runs (size, rank, bin, offset). From
    `rank` on, each next item of that size lies in the next bin, at `offset`."""
    open_by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # bins [a, b)
    rooms, made, runs = 0, 0, []  # bit r of rooms is set if bins with room r are open
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                a, b = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms ^= 1 << room
            else:
                room, a, b = capacity, made, made - (-left // (capacity // size))
                made = b
            most = min(b - a, -(-left // (room // size)))
            if a + most < b:
                open_by_room[room].append((a + most, b))
                rooms |= 1 << room
            runs.append((size, rank, a, capacity - room))
            rank, left = rank + most, left - most
            if room > size:
                open_by_room[room - size].append((a, a + most))
                rooms |= 1 << (room - size)
    return runs


def leaves(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents, packed inside their partition."""
    names = [part.split()[0] for part in LEAF.split(", ")]
    end = np.uint32(end_id).astype("<u4").tobytes()

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        """rows: [doc_id, piece, start, length, crc, uid]; full pieces have sequences of their own."""
        n = len(rows)
        sequence, offset, rank = [None] * n, [None] * n, [None] * n
        small = []
        for i, row in enumerate(rows):
            if row[3] == capacity:
                sequence[i], offset[i] = row[5], 0
            else:
                small.append(i)
        done, up = settle([rows[i][3] for i in small], capacity, False)
        for own in done:
            at = 0
            for k in own:
                i = small[k]
                sequence[i], offset[i] = rows[small[own[0]]][5], at
                at += rows[i][3]
        for own in up:
            for place, k in enumerate(own):
                rank[small[k]] = place
        columns = [*list(zip(*rows))[:5], sequence, offset, [rows[0][5]] * n, rank]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 7]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        yield from (made.slice(a, CARRIED) for a in range(0, n, CARRIED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokenizer(path)
        uid, rows = TaskContext.get().partitionId() << 40, []
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.ids(as_text(batch.column("text")))):
                ids += end
                total = len(ids) // 4
                start = 0
                length = total % capacity or capacity
                piece = 0
                while start < total:
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), uid))
                    uid, piece, start, length = uid + 1, piece + 1, start + length, capacity
                    if len(rows) >= BLOCK:
                        yield from flush(rows)
                        rows = []
        if rows:
            yield from flush(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LEAF)


def placed(ranked: DataFrame, runs: list[tuple[int, int, int, int]]) -> DataFrame:
    """Sequence and offset of open pieces by their length and their rank among all of it."""
    keys = np.array(sorted(runs), np.int64).reshape(-1, 4)
    shared = ranked.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, bins, offset = np.ascontiguousarray(shared.value.T)
        edges = np.searchsorted(size, np.arange(size[-1] + 2)) if len(size) else size
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                mine = length == one
                at[mine] = edges[one] + np.searchsorted(first[edges[one] : edges[one + 1]], rank[mine], side="right") - 1
            columns = [*(batch.column(c) for c in COLUMNS), pa.array(SHARED + bins[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*COLUMNS, "sequence_id", "offset"])

    schema = LEAF.split(", node")[0]
    return ranked.select(*COLUMNS, "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ready_workers(docs.sparkSession)
    base = materialise(leaves(docs, path, capacity, end_id), "packing")
    kept = base.where("sequence_id IS NOT NULL").select(*COLUMNS, "sequence_id", "offset")
    loose = base.where("sequence_id IS NULL").select(*COLUMNS, "node", "rank")
    counts = materialise(loose.groupBy("node", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("node")) - F.col("n")
    starts = counts.select("node", "length", before.alias("before"))
    ranked = loose.join(starts, ["node", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return kept.unionByName(placed(ranked, best_fit_counts(totals, capacity)))
