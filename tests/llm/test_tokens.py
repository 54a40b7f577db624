"""Token counts, the piece codec and byte-level ids against their libraries."""

import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import texts
from tickloom.llm.byte_tokens import ByteTokenizer, byte_tokenizer
from tickloom.llm.piece_codec import codec, encode_texts
from tickloom.llm.pieces import pre_tokens
from tickloom.llm.token_counts import Merger, count_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\n\n", "\t", "a", "e", "th", "the", "▁", "é", "漢", "<s>", "<0x0A>", "=", "==", "ing", ".", "\x00", "😀", "1", "23", "<|endoftext|>", "'s", " ", "\x85"]
TEXTS = st.lists(st.sampled_from(BITS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def merger():
    return Merger(PIECES)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_and_ids_equal_the_library(library, merger, text):
    wanted = library.encode(text)
    parts = [p for p in pre_tokens(text).split(" ") if p]
    assert sum(merger.count(parts)) == len(wanted) if parts else not wanted
    ids = codec(PIECES).encode(text)
    assert ids == [1, *wanted, 2]
    assert codec(PIECES).decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", [" " * n for n in (1, 15, 16, 17, 33, 400)] + ["a" * 333, "=" * 500 + " x", "ab" * 300])
def test_long_runs(library, merger, text):
    wanted = library.encode(text)
    assert sum(merger.count([p for p in pre_tokens(text).split(" ") if p])) == len(wanted)
    assert codec(PIECES).encode(text) == [1, *wanted, 2]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_ids_equal_the_library(text):
    wanted = _encode(text)
    assert byte_tokenizer(BYTES).ids([text])[0] == struct.pack(f"<{len(wanted)}I", *wanted)


_held = {}


def _encode(text):
    from tokenizers import Tokenizer

    library = _held.setdefault("library", Tokenizer.from_file(BYTES))
    return library.encode(text, add_special_tokens=False).ids


def test_odd_documents(spark, odd, library):
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    counts = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in count_tokens(odd, PIECES).collect())
    assert counts == sorted((i or -1, len(t.encode()), len(library.encode(t))) for i, t in texts)
    rows = encode_texts(odd, PIECES).collect()
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids), r.decoded) for r in rows)
    ids = {t: [1, *library.encode(t), 2] for _, t in texts}
    assert got == sorted((i or -1, len(ids[t]), struct.pack(f"<{len(ids[t])}I", *ids[t]), library.decode(ids[t])) for i, t in texts)


def test_empty_table_and_clashing_columns(documents):
    docs = documents([]).selectExpr("*", "1 AS n_tokens", "'x' AS ids", "2 AS decoded")
    assert count_tokens(docs, PIECES).collect() == [] and encode_texts(docs, PIECES).collect() == []
    one = documents([(1, "hello")]).selectExpr("*", "1 AS n_tokens", "'x' AS ids")
    assert count_tokens(one, PIECES).columns == ["doc_id", "n_bytes", "n_tokens"]
    assert encode_texts(one, PIECES).count() == 1


def test_pieces_of_random_words(library, merger):
    draw = random.Random(5)
    words = ["▁" + "".join(draw.choice("aeiouthnrsl") for _ in range(draw.randint(1, 25))) for _ in range(3000)]
    assert merger.count(words) == [len(library.encode(w[1:])) for w in words]


def test_batches_for_workers_are_bounded_by_bytes(spark):
    """Rows of 10,000 characters came 10,000 at a time, so a batch had up to 64 MB."""
    from tickloom.llm import texts

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    texts.ready_workers(spark)
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), 10_000, "x").alias("text"))
    found = rows.mapInArrow(run, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) < 2 * texts.BATCH_BYTES


def test_words_that_come_again_are_encoded_once():
    tokens, asked = ByteTokenizer(BYTES), []
    encode = tokens.parts.compute
    tokens.parts.compute = lambda keys: asked.append(len(keys)) or encode(keys)
    text = " ".join(f"w{k}" for k in range(450_000))
    first = tokens.ids([text])
    assert sum(asked) == 450_001  # the first word also as it stands without a space
    assert tokens.ids([text]) == first and sum(asked) == 450_001


def test_values_are_kept_through_a_stage_and_no_longer(monkeypatch):
    made = []
    own = texts.Kept(lambda parts: [made.append(p) or p * 2 for p in parts])
    for stage in (3, 3, 4):
        monkeypatch.setattr(texts, "this_stage", lambda: stage)
        list(texts.slices([]))  # a task begins
        assert own.values(["a"]) == ["aa"]
    assert made == ["a", "a"]
    monkeypatch.setattr(texts, "this_stage", lambda: 5)
    list(texts.slices([]))
    assert not own.kept
