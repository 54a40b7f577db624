"""Near duplicates, repeated passages and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from tickloom.llm import repeats, simhash
from tickloom.llm.components import components


def groups(n, links):
    """Least node reached, by union-find."""
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("n,m,seed", [(40, 30, 1), (200, 150, 2), (60, 59, 3)])
def test_components(spark, n, m, seed):
    draw = random.Random(seed)
    links = [(k, k + 1) for k in range(n - 1)] if seed == 3 else [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
    got = {r.a: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = groups(n, links)
    assert all(got.get(k, k) == wanted[k] for k in range(n))


def brute_fingerprint(text, words):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))] if own else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def check_components(docs, words, bits):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None), key=lambda r: r[0])
    prints = [brute_fingerprint(t, words) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= bits]
    wanted = {(rows[k][0], prints[k], rows[g][0]) for k, g in enumerate(groups(len(rows), links))}
    found = simhash.near_components(docs, words, bits).collect()
    assert {(r.doc_id, r.l0 % 2**64, r.component_id) for r in found if r.doc_id is not None} == wanted
    assert len(found) == docs.count()


def test_odd_documents(odd):
    check_components(odd, 4, 4)


def test_near_copies(documents):
    draw = random.Random(9)
    rows, word = [], lambda: draw.choice("abcdefghij") * draw.randint(1, 6)
    for k in range(30):
        base = [word() for _ in range(120)]
        for c in range(draw.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(c):
                copy[draw.randrange(120)] = word()
            rows.append((len(rows) * 3 + k, " ".join(copy)))
    check_components(documents(rows), 4, 4)


def test_groups_of_every_size_find_all_links():
    draw = np.random.default_rng(4)
    for size in (2, 30, 200):
        centre = draw.integers(0, 2**63, 1, dtype=np.uint64)
        flips = np.uint64(1) << draw.integers(0, 64, (size, 3)).astype(np.uint64)
        codes = np.unique(centre ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
        codes = np.concatenate([codes, draw.integers(0, 2**63, size, dtype=np.uint64)])
        label = simhash.group_links(codes[:, None], np.zeros(len(codes), np.int64), 4)
        near = [(a, b) for a in range(len(codes)) for b in range(a) if int(codes[a] ^ codes[b]).bit_count() <= 4]
        assert label.tolist() == groups(len(codes), near)


def test_large_groups_are_dealt_over_block_pairs(documents, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rows = [(k, f"one two three four five six seven eight nine ten {'x' * (k % 9)}") for k in range(40)]
    check_components(documents(rows), 4, 4)


def test_one_of_each_group_stays(documents):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(1, base), (2, base), (3, base.replace("w7 ", "v7 ")), (4, " ".join(f"z{k}" for k in range(200))), (5, None), (None, base)]
    kept = simhash.one_of_each(documents(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "None"]


def replaced(words, count, name):
    """A copy with `count` words replaced, five or more apart: five shingles each."""
    step = len(words) // count
    return [f"{name}{k}" if k % step == step // 2 and k // step < count else w for k, w in enumerate(words)]


def jaccard(a, b):
    a, b = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_a_family_below_the_similarity_stays(documents):
    base = [f"w{k}" for k in range(304)]
    family = [replaced(base, 8, f"m{c}x") for c in range(60)]
    loose = [["foo"] * 60 + [f"t{c}x{k}" for k in range(20)] for c in range(3)]  # one shingle outweighs the others
    assert all(0.75 < jaccard(a, b) < 0.8 for a in [base, *family] for b in family if a is not b)
    texts = [base, *family, *loose, family[5], ["w", *family[7]]]  # the last two are copies
    kept = simhash.one_of_each(documents([(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in kept) == list(range(64))


def test_isolated_pairs_just_above_the_similarity(documents):
    pairs = []
    for k in range(150):
        base = [f"p{k}w{i}" for i in range(184)]
        pairs += [base, replaced(base, 3 + k % 2, f"p{k}m")]
    assert all(0.8 <= jaccard(a, b) < 0.85 for a, b in zip(pairs[::2], pairs[1::2]))
    found = simhash.one_of_each(documents([(k, " ".join(t)) for k, t in enumerate(pairs)])).collect()
    ids = {r.doc_id for r in found}
    assert ids >= set(range(0, 300, 2)) and len(ids) <= 150 + 3


def test_pairs_that_no_mask_finds_are_found(documents):
    """One mask finds few of them; none of the similarity stays, and none below it goes."""
    pairs = []
    for k in range(80):
        base = [f"p{k}w{i}" for i in range(184 - k)]
        pairs += [base, replaced(base, 2 + k % 4, f"p{k}m") if k % 3 else base + [f"p{k}n{i}" for i in range(k)]]
    similar = [jaccard(a, b) >= 0.8 for a, b in zip(pairs[::2], pairs[1::2])]
    assert 30 < sum(similar) < 70
    rows = [(k, " ".join(t)) for k, t in enumerate(pairs)]
    found = simhash.one_of_each(documents(rows), recall=0.01).collect()
    assert {r.doc_id for r in found} == {k for k in range(160) if k % 2 == 0 or not similar[k // 2]}


@pytest.mark.parametrize("paired,counters", [(256, 1 << 18), (6, 256)])
def test_families_of_shared_passages_against_brute_force(documents, monkeypatch, paired, counters):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "COUNTERS", counters)
    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passages, texts = [words(60) for _ in range(4)], []
    for k in range(40):
        base = draw.choice(passages) + words(draw.randrange(0, 60)) + draw.choice(passages)
        for c in range(draw.choice([0, 1, 1, 3])):
            texts.append([w if draw.random() > 0.012 * c else words(1)[0] for w in base])
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    wanted = groups(len(texts), links)
    assert 10 < len(set(wanted)) < len(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    found = simhash.one_of_each(documents([*rows, *rows[:5]]), recall=0.01).collect()
    assert {r.doc_id for r in found} == set(wanted)


@pytest.mark.parametrize("dealt", [False, True])
def test_similar_rows_against_brute_force(documents, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(simhash, "SET_ROWS", 4)
    base = [f"w{k}" for k in range(204)]
    texts = [replaced(base, c % 7 + 1, f"m{c}x") for c in range(40)]
    links = [(a, b) for a in range(40) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    docs = documents([(k, " ".join(t)) for k, t in enumerate(texts)])
    families = docs.selectExpr("doc_id", "CAST(0 AS BIGINT) AS family", "CAST(200 AS BIGINT) AS n")
    found = [(r.a, r.b) for r in simhash.verified(docs, families, 5, 0.8).collect()]
    assert groups(40, found) == groups(40, links)


def brute_repeats(rows, size):
    """(words, removed, kept words) of each id; rows in order of id."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


def passages(seed, count=60):
    """Texts of a small vocabulary that share passages, copy each other and repeat themselves."""
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "c", f"w{draw.randrange(400)}"])
    shared = [[word() for _ in range(draw.randint(5, 70))] for _ in range(6)]
    rows = []
    for k in range(count):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += draw.choice(shared) if draw.random() < 0.5 else [word() for _ in range(draw.randint(1, 30))]
        rows.append((k * 2, "  ".join(words) if k % 3 else "\n".join(words)))
    rows += [(k * 2 + 1, rows[k][1]) for k in range(0, count, 7)]
    return rows


@pytest.mark.parametrize("size,seed", [(20, 1), (8, 2), (20, 3)])
def test_removed_words(documents, size, seed):
    rows = passages(seed)
    found = repeats.remove_repeats(documents(rows), size).collect()
    got = {r.doc_id: (r.tl_n_words, r.tl_n_removed, bytes(r.tl_kept)) for r in found}
    assert got == brute_repeats(rows, size)
    assert all(r.tl_text.split() == bytes(r.tl_kept).decode().split() for r in found)
    for r in found:
        spans = list(zip(r.tl_spans[::2], r.tl_spans[1::2]))
        assert sum(b - a for a, b in spans) == r.tl_n_removed


def test_repeats_of_odd_documents(odd):
    found = repeats.remove_repeats(odd, 20).collect()
    assert len(found) == odd.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r.tl_n_words, r.tl_n_removed, bytes(r.tl_kept)))
    rows = {(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None}
    assert {i: v for i, v in by_id.items() if i is not None} == {i: {v} for i, v in brute_repeats(list(rows), 20).items()}
    assert by_id[None] == {(4, 0, b"no id at all")}


def test_empty_tables_and_extra_columns(documents):
    extra = documents([(1, "a b c"), (2, "a b c")]).selectExpr("*", "1 AS component_id", "2 AS node", "3 AS doc", "4 AS anchor", "5 AS l0")
    assert {r.component_id for r in simhash.near_components(extra, 4, 4).collect()} == {1}
    assert repeats.remove_repeats(extra, 3).where("tl_n_removed = 3").count() == 1
    none = documents([])
    assert simhash.near_components(none, 4, 4).collect() == [] and repeats.remove_repeats(none).collect() == []
    assert simhash.one_of_each(none).collect() == []


def test_slices_of_packed_rows_are_bounded_by_their_text():
    import pyarrow as pa
    import zstandard

    from tickloom.llm import repeats, texts

    small = zstandard.ZstdCompressor(level=1).compress(b"same words again " * 180_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([small] * 6, pa.binary())], ["doc_id", "text"])
    pieces = list(repeats.unpacked([batch]))
    assert sum(p.num_rows for p in pieces) == 6 and max(p.column("text").nbytes for p in pieces) < 2 * texts.SLICE_BYTES


def test_repeats_without_kept_words(documents):
    from tickloom.llm import repeats

    line = " ".join(f"w{k}" for k in range(30))
    docs = documents([(1, line), (2, f"new {line} end"), (3, None)])
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    for r in repeats.remove_repeats(docs, with_kept=False).collect():
        assert "tl_kept" not in r and r.asDict() == {k: v for k, v in rows[r.doc_id].asDict().items() if k != "tl_kept"}


def test_a_large_group_is_linked_under_few_masks(documents, monkeypatch):
    """Links that are contracted grow with the group, not with group and masks; families stay the same."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for k in range(240):
        copy = list(base)
        for at in draw.sample(range(150), 2 if k else 0):
            copy[at] = word()
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(word() for _ in range(60))) for k in range(60)]
    docs, made = documents(rows), []

    def counted(links):
        made.append(links.distinct().count())
        return components(links)

    monkeypatch.setattr(simhash, "components", counted)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, *range(1000, 1060)]
    assert sum(made[:-1]) <= (simhash.FIRST_MASKS + 1) * 240  # the last are the verified links
    codes = [f"l{k}" for k in range(8)]
    nodes = simhash.set_prints(docs, 5, 8).withColumnRenamed("doc_id", "node").select("node", *codes).cache()
    masks = simhash.sampled_masks(8, 16, 60)
    rounds = {tuple(r) for r in simhash.code_families(nodes, 8, 105, masks).collect()}
    whole = components(simhash.linked_long(nodes.selectExpr("*", "node AS part"), 8, 105, masks))
    assert rounds == {tuple(r) for r in whole.collect()} and len(rounds) >= 240


def test_texts_are_cut_into_paths_a_megabyte_at_a_time():
    texts = ["word " * 40_000] * 40  # 8 MB, few bytes when packed
    batch = pa.RecordBatch.from_arrays([pa.array([zstandard.compress(t.encode()) for t in texts])], ["text"])
    pieces = list(repeats.unpacked(iter([batch])))
    assert [t for p in pieces for t in p.column("text").to_pylist()] == texts
    assert max(p.column("text").nbytes for p in pieces) < 1.3 * (1 << 20)
