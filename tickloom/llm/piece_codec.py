"""Piece encoding by a table of each prefix's last token, and decoding.

The encoding of a prefix ends in one token only: a piece that ends there, found
by the automaton, whose predecessor (the last token of the prefix before it) is
compatible with it. Two tokens are compatible if merging their joined text
gives these two tokens back. A sequence in which all neighbours are compatible
is what greedy merging yields: up to the first merge across a border, each
token merges as it would alone, and the two tokens beside that border would
have crossed it in their own test. The ids are read backwards from the table.

Empty and null texts give the begin and end ids only. Characters that are no
piece become their bytes. Rows are independent: ties and repeated rows keep one
row each, and other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.pieces import load_pieces, pre_tokens
from tickloom.llm.texts import Kept, as_text, map_texts, parts_of

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
COMPATIBLE_KEPT = 1_000_000
KEPT = 400_000

codecs.register_error("each", lambda e: ("�" * (e.end - e.start), e.end))


class Codec:
    def __init__(self, path: str):
        import ahocorasick

        self.pieces = load_pieces(path)
        self.steps = {i: self.alone(p) for p, i in self.pieces.ids.items()}
        self.found = ahocorasick.Automaton()
        for piece, i in self.pieces.ids.items():
            if self.steps[i] is not None:  # the others never come out of merging
                self.found.add_word(piece, (len(piece), i))
        self.found.make_automaton()
        self.known: dict[int, bool] = {}

    def alone(self, piece: str) -> list[tuple[float, int, int]] | None:
        """How a piece comes about by itself: the order of each merge, and the
        first and last symbol before it; None if merging gives something else."""
        ids, pairs = self.pieces.ids, self.pieces.pairs
        symbols = [ids.get(c, -1) for c in piece]
        steps = []
        while len(symbols) > 1:
            best = min(((pairs[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in pairs), default=None)
            if best is None:
                return None
            order, k = best
            steps.append((order, symbols[0], symbols[-1]))
            symbols[k : k + 2] = [pairs[symbols[k], symbols[k + 1]][1]]
        steps.append((float("inf"), symbols[0], symbols[0]))
        return steps if symbols[0] == ids[piece] else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border. Left wins ties: its pairs start earlier."""
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= COMPATIBLE_KEPT:
                self.known.clear()
            known = self.known[key] = self.test(left, right)
        return known

    def test(self, left: int, right: int) -> bool:
        a, b, pairs = self.steps[left], self.steps[right], self.pieces.pairs
        i = j = 0
        while True:
            across = pairs.get((a[i][2], b[j][1]))
            if across and across[0] < a[i][0] and across[0] <= b[j][0]:
                return False
            if a[i][0] <= b[j][0]:
                if a[i][0] == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def encode_part(self, part: str) -> list[int]:
        """Ids of one pre-token."""
        n = len(part)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        by_end: dict[int, list] = {}
        for end, match in self.found.iter(part):
            by_end.setdefault(end + 1, []).append(match)
        for end in range(1, n + 1):
            for size, token in by_end.get(end, ()):
                before = last[end - size]
                if end == size or before is None or before[1] < 0 or self.compatible(before[1], token):
                    last[end] = (size, token)
                    break
            else:
                last[end] = (1, -1)  # a character that is no piece
        ids: list[int] = []
        while n:
            size, token = last[n]
            if token >= 0:
                ids.append(token)
            else:
                ids.extend(self.pieces.byte_ids[x] for x in reversed(part[n - 1].encode()))
            n -= size
        return ids[::-1]

    def parts(self, new: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Number of ids, ids as little-endian 32 bits, and their decoded bytes."""
        made = []
        for part in new:
            ids = self.encode_part(part)
            made.append((len(ids), struct.pack(f"<{len(ids)}I", *ids), b"".join([self.pieces.surface[i] for i in ids])))
        return made

    def encode(self, text: str) -> list[int]:
        return [self.pieces.begin, *(i for p in pre_tokens(text).split(" ") if p for i in self.encode_part(p)), self.pieces.end]

    def decode(self, ids: Iterable[int]) -> str:
        return joined(b"".join(self.pieces.surface[i] for i in ids))


def joined(decoded: bytes) -> str:
    """Decoded bytes as text, without the space that encoding put in front."""
    return decoded.removeprefix(b" ").decode("utf-8", "each")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Kept:
    return Kept(codec(path).parts, KEPT)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32 bits, begin and end
    included) and the text that the ids decode to, for every whole text."""

    def work(piece: pa.RecordBatch) -> dict:
        pieces = load_pieces(path)
        begin, end = struct.pack("<I", pieces.begin), struct.pack("<I", pieces.end)
        parts = parts_of([pre_tokens(t) for t in as_text(piece.column("text"))])
        made = encoder(path).values(parts.distinct)
        rows = []
        for a, b in zip(parts.edges, parts.edges[1:]):
            values = [made[c] for c in parts.codes[a:b].tolist()]
            rows.append(
                (
                    2 + sum(v[0] for v in values),
                    b"".join([begin, *(v[1] for v in values), end]),
                    joined(b"".join([v[2] for v in values])),
                )
            )
        return {
            "doc_id": piece.column("doc_id"),
            "n_tokens": [r[0] for r in rows],
            "ids": pa.array([r[1] for r in rows], pa.binary()),
            "decoded": pa.array([r[2] for r in rows], pa.string()),
        }

    return map_texts(docs, SCHEMA, work)
