"""Token ids of a byte-level tokenizer file, with the ids of frequent parts kept."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.texts import Kept, parts_of

JOINED = 500
#: rare words cost most here, so more are kept than elsewhere
KEPT = 700_000
_DOUBLE = re.compile(r"\s\s")
_BEFORE_WORD = re.compile(r" (?=\S)")


class ByteTokenizer:
    """Encodes texts in parts that the tokenizer's own pattern never joins.

    A space starts a new part if a word follows it; a line end between two words
    stands by itself. In texts with longer runs of white space, only a space
    before a word is a border. Parts are encoded by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        before = described["pre_tokenizer"] or {}
        if described["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError("needs a byte-level tokenizer with the usual word pattern")
        if any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in described["added_tokens"]):
            raise ValueError("added tokens must not take white space")
        self.library = Tokenizer.from_file(path)
        #: bytes that each token stands for; each symbol of a token's name is one byte
        self.sizes = np.zeros(max(self.library.get_vocab(True).values()) + 1, np.int64)
        for name, token in self.library.get_vocab(False).items():
            self.sizes[token] = len(name)
        for token in described["added_tokens"]:
            self.sizes[token["id"]] = len(token["content"].encode())
        self.parts = Kept(self.encode_parts, KEPT)

    def encode_parts(self, keys: list) -> list[bytes]:
        """A key is a word after a space, a line end with what follows it, or (text,) as it is.

        The first two kinds are encoded many at a time, end to end; the bytes of
        the tokens tell where each key's ids end.
        """
        made: list = [None] * len(keys)
        plain = [k for k, key in enumerate(keys) if isinstance(key, str) and key != "\n"]
        runs = [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)]
        texts = [[key if (key := keys[k])[:1] == "\n" else " " + key for k in run] for run in runs]
        for run, own, found in zip(runs, texts, self.library.encode_batch_fast(["".join(t) for t in texts], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            reached = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(pc.binary_length(pa.array(own, pa.string())).to_numpy(), dtype=np.int64)
            ends = np.searchsorted(reached, wanted) + 1
            if len(reached) < ends[-1] or (reached[ends - 1] != wanted).any():
                continue  # each for itself, below
            raw, start = ids.tobytes(), 0
            for k, end in zip(run, (4 * ends).tolist()):
                made[k] = raw[start:end]
                start = end
        alone = [k for k, ids in enumerate(made) if ids is None]
        texts = [key[0] if isinstance(key := keys[k], tuple) else key if key[:1] == "\n" else " " + key for k in alone]
        for k, found in zip(alone, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            made[k] = np.array(found.ids, "<u4").tobytes()
        return made

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        simple = [bool(t) and not (_DOUBLE.search(t) or t[0] in " \n" or t[-1] == " ") for t in texts]
        words = parts_of([t.replace("\n", " \n") if plain else "" for t, plain in zip(texts, simple)])
        made = self.parts.values(words.distinct)
        # the first word of a text has no space before it, and other texts are cut before words only
        first = {k: (words.distinct[words.codes[words.edges[k]]],) for k, plain in enumerate(simple) if plain}
        other = {k: self.cut(texts[k]) for k, plain in enumerate(simple) if not plain}
        rare = list({*first.values(), *(p for own in other.values() for p in own)})
        rare_ids = dict(zip(rare, self.parts.values(rare)))
        out = []
        for k, plain in enumerate(simple):
            if plain:
                own = words.codes[words.edges[k] + 1 : words.edges[k + 1]].tolist()
                out.append(b"".join([rare_ids[first[k]], *map(made.__getitem__, own)]))
            else:
                out.append(b"".join([rare_ids[p] for p in other[k]]))
        return out

    @staticmethod
    def cut(text: str) -> list[tuple[str]]:
        if not text:
            return []
        first, *rest = _BEFORE_WORD.split(text)
        return [(first,), *((" " + r,) for r in rest)]


@functools.lru_cache(maxsize=4)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)
