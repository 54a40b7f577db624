"""Token counts by rank-synchronous array merging.

Pre-tokens of a slice lie end to end in one array of symbols. In each round
every pre-token applies its own lowest-ranked pair (the leftmost of equals), all
of them at once; the symbols that survive are the tokens. One merge per
pre-token and round keeps the library's exact order, also where a new pair
ranks before the one that made it.

Empty and null texts have no token; rows are independent, so ties and repeated
rows keep one row each; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.pieces import NONE, load_pieces, pre_tokens
from tickloom.llm.texts import Kept, as_text, map_texts, parts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
KEPT = 400_000


class Merger:
    """Pair tables of a vocabulary as sorted arrays."""

    def __init__(self, path: str):
        pieces = load_pieces(path)
        self.size = len(pieces.names)
        keys = np.array([a * self.size + b for a, b in pieces.pairs], dtype=np.int64)
        values = np.array(list(pieces.pairs.values()), dtype=np.int32).reshape(-1, 2)
        by = np.argsort(keys)
        self.keys, self.order, self.merged = keys[by], values[by, 0], values[by, 1]
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in pieces.ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and merged id of each pair; NONE where it doesn't merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.order[at], NONE), np.where(hit, self.merged[at], -1)

    def count(self, parts: list[str]) -> list[int]:
        """Surviving symbols of each pre-token; an unknown character counts its bytes."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        symbol = self.char[points]
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        extra = np.where(symbol < 0, (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), 0)
        total = np.bincount(owner, weights=extra, minlength=len(parts)).astype(np.int64)
        order, merged = self.pairs_of(symbol, owner)
        while len(symbol):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            low = np.minimum.reduceat(order, first)
            sizes = np.diff(np.append(first, len(owner)))
            done = low == NONE
            total[owner[first[done]]] += sizes[done]
            if done.all():
                break
            wanted = np.repeat(low, sizes)
            place = np.flatnonzero((order == wanted) & (wanted != NONE))
            place = place[np.diff(owner[place], prepend=-1) != 0]
            symbol[place] = merged[place]
            keep = np.repeat(~done, sizes)
            keep[place + 1] = False
            new = np.cumsum(keep) - 1
            place = new[place]
            symbol, owner, order, merged = symbol[keep], owner[keep], order[keep], merged[keep]
            touched = np.concatenate([place, place[place > 0] - 1])
            self.update(symbol, owner, order, merged, touched)
        return total.tolist()

    def pairs_of(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, merged = np.full(len(symbol), NONE, np.int32), np.full(len(symbol), -1, np.int32)
        self.update(symbol, owner, order, merged, np.arange(len(symbol)))
        return order, merged

    def update(self, symbol, owner, order, merged, at) -> None:
        """Pairs that start at the places `at`, again."""
        order[at], merged[at] = NONE, -1
        at = at[at + 1 < len(symbol)]
        at = at[owner[at] == owner[at + 1]]
        order[at], merged[at] = self.look(symbol[at], symbol[at + 1])


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Kept:
    return Kept(Merger(path).count, KEPT)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text."""

    def work(piece: pa.RecordBatch) -> dict:
        texts = as_text(piece.column("text"))
        parts = parts_of([pre_tokens(t) for t in texts])
        counts = np.array(counter(path).values(parts.distinct), np.int64)
        return {
            "doc_id": piece.column("doc_id"),
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": parts.sums(counts[parts.codes]).astype(np.int64),
        }

    return map_texts(docs, SCHEMA, work)
