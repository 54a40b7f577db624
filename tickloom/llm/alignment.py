"""Alignment of two tokenizers over the same bytes, as products of sparse matrices.

A byte-level tokenizer A encodes a space and the text, a piece model B the text,
to which it adds the space. Each token is a row of an incidence matrix over the bytes, with a
one for every byte it holds; matrices are kept as compressed rows, built and
multiplied here. Row products by Gustavson's method give
- A times B transposed: the overlap links, with the number of shared bytes;
- last bytes of A times last bytes of B transposed: the links of tokens that end together;
- token to group of A times that of B transposed: all pairs inside one group,
  where groups are the runs of bytes between places at which a token of both ends.

Texts are cut where neither tokenizer joins: at a space or line end between two
characters that are no white space. The products are made once for each different segment
of a task (the first KEPT are held), for many segments at a time as one block-diagonal
matrix, and a text's links are those of its segments.

Corpus counts stay in Spark. A task writes one row per slice of texts: its
documents, its different id pairs with their counts, and the documents' links as 16 or
32 bit codes into these pairs. Pairs are counted over slices with map-side combine; the
highest count of each B id has at most one row per id, so it is broadcast; counts
come back to the slices by joins on pair and slice. No pair and no slice
is a hot key: a slice holds a pair once, and has a bounded text (or one document).

A null or empty text, or one whose tokens' bytes are not the space and the text
(B reads U+2581 as a space), has no tokens: counts are 0 and its groups are ''. Rows of
equal or null ids are separate rows. Special strings are plain text. Only doc_id and text are read;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.texts import Kept, as_text, ready_workers, slices
from tickloom.session import materialise

KEPT = 150_000
#: bytes of new segments whose products are made at a time
PRODUCT_BYTES = 1 << 17
#: segments that are encoded end to end
JOINED = 500
_JOINED = r"\s\s|^\s|\s$|[\x0B\x0C\r\t\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CUT = re.compile(r"(?<=\S)(?= \S|\n\S)")
_SPACE = "▁"


# --- compressed rows --------------------------------------------------------------


@dataclass
class Rows:
    """A sparse matrix: row i holds `columns[starts[i]:starts[i + 1]]` with `values` there."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def owners(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(starts, self.owners()[order], self.values[order], self.height)

    def times(self, other: Rows) -> Rows:
        """Gustavson's product: row i is the sum of the rows of `other` at the columns of row i."""
        sizes = np.diff(other.starts)[self.columns]
        entry = np.repeat(np.arange(len(self.columns)), sizes)
        within = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = other.starts[self.columns][entry] + within
        row, column = self.owners()[entry], other.columns[at]
        values = self.values[entry] * other.values[at]
        key = row * other.width + column
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        summed = np.add.reduceat(values, first) if len(first) else values
        row, column = np.divmod(key[first], other.width) if other.width else (key[first], key[first])
        return Rows(np.searchsorted(row, np.arange(self.height + 1)), column, summed, other.width)


def incidence(sizes: np.ndarray) -> Rows:
    """Tokens that follow each other, over bytes: row i has a one at each of its bytes."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return Rows(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def last_bytes(sizes: np.ndarray) -> Rows:
    """Tokens over bytes, with a one at the last byte only."""
    ends = np.cumsum(sizes)
    return Rows(np.arange(len(sizes) + 1), ends - 1, np.ones(len(sizes), np.int64), int(ends[-1]) if len(ends) else 0)


def memberships(sizes: np.ndarray, group_ends: np.ndarray) -> Rows:
    """Tokens over groups, with a one at the group that holds the token."""
    group = np.searchsorted(group_ends, np.cumsum(sizes))
    return Rows(np.arange(len(sizes) + 1), group, np.ones(len(sizes), np.int64), len(group_ends))


@dataclass
class Products:
    """Links of two token sequences over the same bytes; places of tokens, not ids."""

    overlap: Rows  # shared bytes of A i and B j
    together: Rows  # A i and B j end at the same byte
    grouped: Rows  # A i and B j lie in the same group
    group_ends: np.ndarray  # bytes
    a_group: np.ndarray
    b_group: np.ndarray


def products(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Products:
    """All products for two sequences of tokens, given by their bytes."""
    a_last, b_last = last_bytes(a_sizes), last_bytes(b_sizes)
    together = a_last.times(b_last.transposed())
    group_ends = np.cumsum(a_sizes)[together.owners()]
    a_in, b_in = memberships(a_sizes, group_ends), memberships(b_sizes, group_ends)
    overlap = incidence(a_sizes).times(incidence(b_sizes).transposed())
    return Products(overlap, together, a_in.times(b_in.transposed()), group_ends, a_in.columns, b_in.columns)


# --- tokens of segments -------------------------------------------------------------


def _gpt_bytes() -> dict[str, int]:
    """The byte of each symbol of a byte-level vocabulary: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        symbols, names = _gpt_bytes(), self.a.get_vocab(True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, token in names.items():
            known = all(c in symbols for c in name)
            self.a_bytes[token] = bytes(symbols[c] for c in name) if known else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(len(self.b)):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode())
        inner = [p for p in map(self.b.id_to_piece, range(len(self.b))) if "\n" in p or _SPACE in p.lstrip(_SPACE)]
        if inner or self.b.encode("\n", out_type=str)[:1] != [_SPACE]:
            raise ValueError("needs a piece model that adds a space before the text, whose pieces hold no inner space or line end")
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_names, self.b_names = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        #: per segment (tokens of A, tokens of B, groups as text, id pairs of links as bytes), or () if the bytes differ
        self.segments = Kept(self.align, KEPT)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of both sides for each text with its space (or line end) in front; None where the bytes are not the text's."""
        a_ids = [found.ids for found in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B adds the space itself; a text that starts with a line end has none
        b_ids = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for text, a, b in zip(texts, a_ids, b_ids):
            b = b if text[0] == " " else b[1:]
            raw = text.encode()
            fits = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            yield (a, b) if fits else None

    def align(self, segments: list[str]) -> list[tuple]:
        """Values of different segments. Those that begin and end like words are encoded
        many at a time, end to end; where that does not fit, each by itself."""
        made: dict[str, tuple] = {}
        plain = [s for s in segments if len(s) > 1 and not s[1].isspace() and not s[-1].isspace()]
        self._align([plain[k : k + JOINED] for k in range(0, len(plain), JOINED)], made)
        self._align([[s] for s in segments if s not in made], made)
        return [made.get(s, ()) for s in segments]

    def _align(self, runs: list[list[str]], made: dict[str, tuple]) -> None:
        held, size = [], 0
        for k, run in enumerate(runs):
            held.append(run)
            size += sum(map(len, run))
            if size >= PRODUCT_BYTES or k + 1 == len(runs):
                self._multiply(held, made)
                held, size = [], 0

    def _multiply(self, runs: list[list[str]], made: dict[str, tuple]) -> None:
        """One product of block-diagonal matrices for all runs that fit."""
        found = [(run, ids) for run, ids in zip(runs, self.encode(["".join(run) for run in runs])) if ids]
        if not found:
            return
        a_all = np.array([i for _, (a, _) in found for i in a], np.int64)
        b_all = np.array([i for _, (_, b) in found for i in b], np.int64)
        a_sizes, b_sizes = self.a_sizes[a_all], self.b_sizes[b_all]
        p = products(a_sizes, b_sizes)
        pairs = (a_all[p.together.owners()] << 32) | b_all[p.together.columns]
        a_edges, b_edges = (np.searchsorted(side, np.arange(len(p.group_ends) + 1)).tolist() for side in (p.a_group, p.b_group))
        a_text, b_text = [self.a_names[i] for i in a_all.tolist()], [self.b_names[i] for i in b_all.tolist()]
        groups = [
            f"{','.join(a_text[a0:a1])}|{','.join(b_text[b0:b1])}" if a1 - a0 > 1 or b1 - b0 > 1 else f"{a_text[a0]}|{b_text[b0]}"
            for a0, a1, b0, b1 in zip(a_edges, a_edges[1:], b_edges, b_edges[1:])
        ]
        names = [s for run, _ in found for s in run]
        ends = np.cumsum([len(s.encode()) for s in names])
        # a segment stands by itself if both sides have a token border at its start and end
        last = np.searchsorted(p.group_ends, ends)
        whole = p.group_ends[np.minimum(last, len(p.group_ends) - 1)] == ends
        whole &= np.concatenate([[True], whole[:-1]])
        last = np.where(whole, last + 1, last).tolist()
        raw, first = pairs.tobytes(), 0
        for s, end, fine in zip(names, last, whole.tolist()):
            if fine:
                made[s] = (a_edges[end] - a_edges[first], b_edges[end] - b_edges[first], ";".join(groups[first:end]), raw[8 * first : 8 * end])
            first = end

    def texts(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """The different segments' values, the code of every segment end to end, and where each text's begin."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        joined = pc.match_substring_regex(column, _JOINED)
        simple = pc.and_(pc.invert(joined), pc.not_equal(column, ""))
        plain = pc.if_else(simple, pc.replace_substring(column, "\n", " \n"), "")
        lists = pc.split_pattern(plain, " ")
        encoded = lists.flatten().dictionary_encode()
        names = [p if p[:1] == "\n" else " " + p for p in encoded.dictionary.to_pylist()]
        codes, edges = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        place = {n: k for k, n in enumerate(names)}
        parts, sizes = [], np.diff(edges)
        for row, fine in enumerate(simple.to_pylist()):
            if fine:
                parts.append(codes[edges[row] : edges[row + 1]])
                continue
            text = column[row].as_py()
            cut = _CUT.split(" " + text) if text else []
            parts.append(np.array([place.setdefault(s, len(place)) for s in cut], np.int64))
            sizes[row] = len(cut)
        codes = np.concatenate(parts) if parts else np.empty(0, np.int64)
        names = list(place)
        used = np.bincount(codes, minlength=len(names)) > 0
        found = self.segments.values([names[k] for k in np.flatnonzero(used).tolist()])
        return found, (np.cumsum(used) - 1)[codes], np.concatenate([[0], np.cumsum(sizes)])


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# --- per document ---------------------------------------------------------------------


LINK = "struct<a:int,b:int,bytes:int>"
ALIGNMENT = f"doc_id long, a_ids array<int>, b_ids array<int>, a_bytes array<int>, b_bytes array<int>, overlaps array<{LINK}>, groups string"


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment itself: ids and byte lengths of both sides, overlap links with places and shared bytes, and groups."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for piece in slices(batches):
            rows = []
            for text in as_text(piece.column("text")):
                ids = next(tool.encode([" " + text])) if text else None
                if ids is None:
                    rows.append([[], [], [], [], [], ""])
                    continue
                a, b = (np.array(own, np.int64) for own in ids)
                a_sizes, b_sizes = tool.a_sizes[a], tool.b_sizes[b]
                made = products(a_sizes, b_sizes)
                links = zip(made.overlap.owners().tolist(), made.overlap.columns.tolist(), made.overlap.values.tolist())
                # groups from the products' shared-group links: the A and B tokens of each
                sides = [[[] for _ in made.group_ends] for _ in ids]
                for side, own, of in zip(sides, ids, (made.a_group.tolist(), made.b_group.tolist())):
                    for token, group in zip(own, of):
                        side[group].append(str(token))
                groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides))
                rows.append([*ids, a_sizes.tolist(), b_sizes.tolist(), [dict(zip(("a", "b", "bytes"), link)) for link in links], groups])
            ints, link = pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))
            kinds = [ints, ints, ints, ints, link, pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["a_ids", "b_ids", "a_bytes", "b_bytes", "overlaps", "groups"]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNMENT)


DOC = "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string"
SLICES = f"slice long, docs array<struct<{DOC}>>, links binary, pairs array<long>, counts array<long>"


def linked_slices(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per slice of texts: its documents, their links as codes into `pairs`, and how often it holds each pair."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for piece in slices(batches):
            found, codes, edges = tool.texts(piece.column("text"))
            live_of = np.array([bool(s) for s in found], bool)
            whole = [s or (0, 0, "", b"") for s in found]
            n = [np.fromiter((s[k] for s in whole), np.int64, len(whole)) for k in (0, 1)]
            n.append(np.fromiter((len(s[3]) >> 3 for s in whole), np.int64, len(whole)))
            owner = np.repeat(np.arange(piece.num_rows), np.diff(edges))
            broken = np.bincount(owner, weights=~live_of[codes], minlength=piece.num_rows) > 0
            live = ~broken[owner]
            total = [np.bincount(owner[live], weights=x[codes[live]], minlength=piece.num_rows).astype(np.int64) for x in n[:3]]
            texts = [s[2] for s in whole]
            digests = []
            for row in range(piece.num_rows):
                own = ";".join([texts[c] for c in codes[edges[row] : edges[row + 1]].tolist()]) if total[2][row] else ""
                digests.append(hashlib.sha256(own.encode()).hexdigest() if own else "")
            # links of all segments in order of text, as codes of the different pairs
            sizes, used = n[2], codes[live]
            every = np.frombuffer(b"".join([s[3] for s in whole]), np.int64)
            pairs, code = np.unique(every, return_inverse=True)
            first = np.cumsum(sizes) - sizes
            repeat = sizes[used]
            at = np.repeat(first[used], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            links = code[at]
            counts = np.bincount(links, minlength=len(pairs))
            rows = [
                dict(doc_id=i, n_a=a, n_b=b, n_groups=g, n_links=g, groups_sha256=d)
                for i, a, b, g, d in zip(piece.column("doc_id").to_pylist(), *[t.tolist() for t in total], digests)
            ]
            struct = pa.struct([*[(k, pa.int64()) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
            live_pairs = counts > 0
            renumbered = np.cumsum(live_pairs) - 1
            columns = [
                pa.array([number], pa.int64()),
                pa.array([rows], pa.list_(struct)),
                pa.array([renumbered[links].astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()], pa.binary()),
                pa.array([pairs[live_pairs]], pa.list_(pa.int64())),
                pa.array([counts[live_pairs]], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "docs", "links", "pairs", "counts"])
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SLICES)


def pair_counts(held: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), n, and whether that is the highest count of its B id."""
    each = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counted = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    counted = materialise(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pairs")
    best = counted.groupBy("b").agg(F.max("n").alias("most"))  # at most one row per piece of B
    return counted.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


SUMMED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document the numbers of tokens, groups and links, the links that are the
    best of their B id in the corpus, and the sum of their pairs' counts."""
    held = materialise(linked_slices(docs, a_path, b_path), "slices")
    asked = held.select("slice", F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(pair_counts(held), "pair").groupBy("slice")
    found = found.agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("found"))
    both = held.select("slice", "docs", "links").join(found.withColumnRenamed("slice", "__slice"), F.col("slice") == F.col("__slice"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs = pa.RecordBatch.from_struct_array(batch.column("docs").slice(row, 1).flatten())
                links, total = batch.column("links")[row].as_py() or b"", int(docs.column("n_links").to_numpy().sum())
                links = np.frombuffer(links, "<u4" if len(links) > 2 * total else "<u2")
                facts = batch.column("found").slice(row, 1).flatten()
                n = facts.field("n").to_numpy(zero_copy_only=False) if len(facts) else np.empty(0, np.int64)
                best = facts.field("best").to_numpy(zero_copy_only=False) if len(facts) else np.empty(0, bool)
                edges = np.concatenate([[0], np.cumsum(docs.column("n_links").to_numpy())])
                before = [np.concatenate([[0], np.cumsum(v[links], dtype=np.int64)]) for v in (best, n)]
                sums = [pa.array(v[edges[1:]] - v[edges[:-1]]) for v in before]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
                columns = [*[docs.column(c) for c in names], *sums, docs.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum", "groups_sha256"])

    return both.select("docs", "links", "found").mapInArrow(run, SUMMED)
