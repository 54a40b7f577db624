"""Cross-tokenizer alignment against the libraries and a loop over bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "ing", "▁", "é", "漢字", "😀", "<s>", "<0x0A>", "<|endoftext|>", "'s", ".", "123", "\x00", "\x1c", "\x85", "\xa0", "\r\n"]
TEXTS = st.lists(st.sampled_from(BITS), max_size=30).map("".join)


@pytest.fixture(scope="module")
def tool():
    return alignment.Aligner(A, B)


def brute(tool, text):
    """Ids, byte lengths, overlap links, groups and links that end together, byte by byte."""
    none = ([], [], [], [], [], "", [])
    if not text:
        return none
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    wanted = (" " + text).encode()
    if any(b"".join(names[i] for i in ids) != wanted for names, ids in ((tool.a_bytes, a), (tool.b_bytes, b))):
        return none
    sizes = [[len(names[i]) for i in ids] for names, ids in ((tool.a_bytes, a), (tool.b_bytes, b))]
    owners = [[k for k, n in enumerate(own) for _ in range(n)] for own in sizes]
    overlaps = sorted((i, j, n) for (i, j), n in Counter(zip(*owners)).items())
    ends = [set(np.cumsum(own).tolist()) for own in sizes]
    groups, pairs, start = [], [], 0
    for end in sorted(ends[0] & ends[1]):
        own = [list(dict.fromkeys(o[start:end])) for o in owners]
        groups.append("|".join(",".join(str(ids[k]) for k in o) for ids, o in zip((a, b), own)))
        pairs.append((a[own[0][-1]], b[own[1][-1]]))
        start = end
    return a, b, *sizes, overlaps, ";".join(groups), pairs


def joined(tool, text):
    import pyarrow as pa

    found, codes, _ = tool.texts(pa.array([text], pa.string()))
    own = [found[c] for c in codes]
    own = own if all(own) else []
    return sum(s[0] for s in own), sum(s[1] for s in own), ";".join(s[2] for s in own)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_segments_join_to_the_library_tokens(tool, text):
    wanted = brute(tool, text)
    assert joined(tool, text) == (len(wanted[0]), len(wanted[1]), wanted[5])


SIZES = st.lists(st.integers(1, 5), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(SIZES, SIZES)
def test_products_equal_dense_ones(left, right):
    gap = sum(left) - sum(right)
    left, right = (left, [*right, gap]) if gap > 0 else ([*left, -gap], right) if gap else (left, right)
    made = alignment.products(np.array(left), np.array(right))

    def dense(rows):
        out = np.zeros((rows.height, rows.width), int)
        out[rows.owners(), rows.columns] = rows.values
        return out

    a, b = dense(alignment.incidence(np.array(left))), dense(alignment.incidence(np.array(right)))
    assert (dense(made.overlap) == a @ b.T).all()
    a_last, b_last = dense(alignment.last_bytes(np.array(left))), dense(alignment.last_bytes(np.array(right)))
    assert (dense(made.together) == a_last @ b_last.T).all()
    a_in, b_in = dense(alignment.memberships(np.array(left), made.group_ends)), dense(alignment.memberships(np.array(right), made.group_ends))
    assert (dense(made.grouped) == a_in @ b_in.T).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 8), st.integers(1, 8), st.integers(1, 8))
def test_general_products(seed, n, m, k):
    some = np.random.default_rng(seed)
    left, right = [some.integers(0, 3, s) * some.integers(0, 2, s) for s in ((n, m), (m, k))]

    def rows(dense):
        at = np.nonzero(dense)
        return alignment.Rows(np.searchsorted(at[0], np.arange(len(dense) + 1)), at[1], dense[at], dense.shape[1])

    made = rows(left).times(rows(right))
    out = np.zeros((n, k), int)
    out[made.owners(), made.columns] = made.values
    assert (out == left @ right).all()


def check_counts(spark, tool, rows, docs):
    made = [(i, *brute(tool, t)) for i, t in rows]
    n = Counter(p for m in made for p in m[7])
    most = {}
    for (a, b), count in n.items():
        most[b] = max(most.get(b, 0), count)
    wanted = [
        (
            i, len(a), len(b), len(pairs), len(pairs), sum(n[p] == most[p[1]] for p in pairs), sum(n[p] for p in pairs),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for i, a, b, _, _, _, groups, pairs in made
    ]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = [tuple(r) for r in alignment.alignment_counts(docs, A, B).collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_counts_equal_brute_force(spark, folder, tool):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check_counts(spark, tool, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_odd_rows(spark, odd, tool):
    extra = odd.selectExpr("*", "'x' AS slice", "1 AS links", "text AS n_a")
    check_counts(spark, tool, [(r.doc_id, r.text) for r in odd.collect()], extra)
    assert alignment.alignment_counts(odd.limit(0), A, B).collect() == []


def test_a_long_unspaced_text(spark, documents, tool):
    rows = [(1, "ab" * 20_000), (2, "漢" * 20_000), (3, "▁" * 50)]
    check_counts(spark, tool, rows, documents(rows))


def test_alignments_hold_links_and_groups(spark, odd, tool):
    wanted = {i: brute(tool, t) for i, t in [(r.doc_id, r.text) for r in odd.collect()]}
    for r in alignment.alignments(odd, A, B).collect():
        a, b, a_sizes, b_sizes, overlaps, groups, _ = wanted[r.doc_id]
        assert (r.a_ids, r.b_ids, r.a_bytes, r.b_bytes, r.groups) == (a, b, a_sizes, b_sizes, groups)
        assert [tuple(x) for x in r.overlaps] == overlaps


def test_new_segments_take_bounded_memory():
    import random
    import tracemalloc

    draw = random.Random(1)
    segments = list({" " + "".join(draw.choice("etaoinshrdlu") for _ in range(6)) for _ in range(150_000)})
    tool = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    tracemalloc.start()
    try:
        found = tool.align(segments)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == len(segments) and peak < 170 << 20, peak
