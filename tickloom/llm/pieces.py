"""The vocabulary of a merging piece model (sentencepiece file), and its pre-tokens."""

from __future__ import annotations

import functools
import re

import numpy as np

SPACE = "▁"
NONE = np.iinfo(np.int32).max


class Pieces:
    """Pieces, the order in which pairs merge, and byte ids.

    Any two neighbours whose concatenation is a piece may merge; the highest
    score goes first, the leftmost of equals. `order` is the dense rank of the
    scores, lower first. Texts never merge across a space that follows another
    character, nor across a line end; both are checked here.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        self.names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (special[i] or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.begin, self.end = model.bos_id(), model.eos_id()
        if len(self.byte_ids) != 256 or any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("needs a model with byte pieces whose pieces hold no inner space or line end")
        scores = np.array([model.get_score(i) for i in normal])
        dense = np.unique(-scores, return_inverse=True)[1]
        self.order = dict(zip(normal, dense.tolist()))
        #: (left id, right id) -> (order, merged id)
        self.pairs = {
            (self.ids[p[:k]], self.ids[p[k:]]): (self.order[i], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        }
        #: what each id decodes to, in UTF-8
        self.surface = [b"" if special[i] else self.names[i].replace(SPACE, " ").encode() for i in range(n)]
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])


@functools.lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n[^{SPACE}\n]*|{SPACE}+")


def pre_tokens(text: str) -> str:
    """Parts of the normalised text that never merge with each other, with a space between them."""
    if not text:
        return ""
    text = text.replace(SPACE, " ")
    if text[0] == " " or "  " in text:
        return " ".join(_PARTS.findall(SPACE + text.replace(" ", SPACE)))
    return SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n")
