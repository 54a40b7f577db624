"""Class-based scores, quality rules, ranking, personal data and neighbours."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import ann, class_model, pii, quality_rules, ranking
from tickloom.llm.texts import words_of
from tickloom.llm.word_hashes import Runs

def is_held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2



def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def prose(seed, count=60):
    """Two kinds of texts with words of their own."""
    draw = random.Random(seed)
    rows = []
    for k in range(count):
        kind = "abcde" if k % 2 else "vwxyz"
        words = [draw.choice(kind) + str(draw.randrange(12)) for _ in range(draw.randint(5, 60))]
        rows.append((k, " ".join(words) + (f" rare{k}" if k % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("head", [10, 100_000])
def test_base_scores_and_counts(documents, monkeypatch, head):
    monkeypatch.setattr(class_model, "HEAD", head)
    rows = [*prose(1), (200, None), (201, " \n"), (202, "A0 b1"), (202, "A0 b1")]
    words = {i: (t or "").lower().encode().split() for i, t in rows}
    count, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            count.update((t or "").lower().encode().split())
            ends += 1
    total, distinct = sum(count.values()) + ends, len(count) + 1
    found = class_model.class_scores(documents(rows), is_held()).collect()
    assert len(found) == len(rows)
    for r in found:
        own = words[r.doc_id]
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(count[w] for w in own), ends])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own) + 1, sum(count[w] > 0 for w in own) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    if head < 100:
        return  # so few words of their own say nothing about such a small corpus
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_model_sums_to_one(documents):
    docs = documents(prose(2))
    counts = class_model.word_counts(docs)
    words = class_model.most_frequent(counts, 1 << 20)
    vocabulary = class_model.Vocabulary([w for w, _ in words])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    facts = class_model.unit_facts(counts, shared)
    pairs = class_model.unit_pairs(docs, shared).cache()
    sizes = np.array([facts[u][0] for u in range(class_model.UNITS)])
    classes, joint = class_model.exchange(pairs, sizes)
    model = class_model.ClassModel(vocabulary, np.array([n for _, n in words]), classes, joint, facts, 1, 1)
    assert (10**model.moves).sum(axis=1) == pytest.approx(np.ones(class_model.CLASSES))
    kind = model.classes[: len(words)]
    for c in set(kind.tolist()):
        assert (10 ** model.emits[kind == c]).sum() + model.unseen[c] == pytest.approx(1)
    plain = np.zeros(class_model.UNITS, np.int64)
    order = np.argsort(-sizes[1:], kind="stable") + 1
    plain[order] = 1 + np.arange(class_model.UNITS - 1) % (class_model.CLASSES - 1)
    start = class_model.joint_counts(pairs, plain)
    fit = lambda n: class_model._xlogx(n).sum() - class_model._xlogx(n.sum(axis=0)).sum() - class_model._xlogx(n.sum(axis=1)).sum()
    assert fit(joint) > fit(start)


def test_best_class_gain_is_exact():
    draw = np.random.default_rng(3)
    pairs = draw.integers(0, 9, (30, 30))
    classes = draw.integers(1, class_model.CLASSES, 30)

    def joint(of):
        n = np.zeros((class_model.CLASSES, class_model.CLASSES))
        np.add.at(n, (of[:, None].repeat(30, 1), of[None, :].repeat(30, 0)), pairs)
        return n

    def fit(n):
        x = class_model._xlogx
        return x(n).sum() - x(n.sum(axis=0)).sum() - x(n.sum(axis=1)).sum()

    for unit in range(5):
        left, right = np.zeros(class_model.CLASSES), np.zeros(class_model.CLASSES)
        others = np.arange(30) != unit
        np.add.at(left, classes[others], pairs[others, unit])
        np.add.at(right, classes[others], pairs[unit, others])
        new, gain = class_model.best_class(classes[unit], left, right, pairs[unit, unit], joint(classes))
        moved = classes.copy()
        moved[unit] = new
        assert fit(joint(moved)) - fit(joint(classes)) == pytest.approx(gain, abs=1e-6)


def test_best_classes_of_many_words_equal_those_of_one():
    draw = np.random.default_rng(8)
    size = class_model.CLASSES
    counts = draw.integers(0, 5, (40, class_model.ITSELF + 1)) * (draw.random((40, class_model.ITSELF + 1)) < draw.random((40, 1)) / 2)
    own = draw.integers(1, size, 40)
    joint = draw.integers(0, 9, (size, size)).astype(float) + 1000
    word, kind = np.nonzero(counts)
    best, gain = class_model.best_classes(own, word, kind, counts[word, kind], joint)
    for k in range(40):
        left, right, itself = np.split(counts[k].astype(float), [size, 2 * size])
        one, more = class_model.best_class(own[k], left, right, itself[0], joint)
        assert (best[k], gain[k]) == (one, pytest.approx(more, abs=1e-6))


def test_large_counts_of_words_that_follow_themselves_are_judged_as_one_by_one():
    draw = np.random.default_rng(9)
    size = class_model.CLASSES
    counts = draw.integers(0, 4 * class_model.SMALL, (60, class_model.ITSELF + 1)) * (draw.random((60, class_model.ITSELF + 1)) < 0.05)
    counts[:20] = np.minimum(counts[:20], 1)
    counts[30:, class_model.ITSELF] = draw.integers(0, 3 * class_model.SMALL, 30)
    own = draw.integers(1, size, 60)
    joint = draw.integers(0, 9, (size, size)).astype(float) + 5000
    word, kind = np.nonzero(counts)
    best, gain = class_model.best_classes(own, word, kind, counts[word, kind], joint)
    for k in range(60):
        left, right, itself = np.split(counts[k].astype(float), [size, 2 * size])
        one, more = class_model.best_class(own[k], left, right, itself[0], joint)
        assert (best[k], gain[k]) == (one, pytest.approx(more, abs=1e-6))


def test_units_of_a_vocabulary_are_found_once(monkeypatch):
    asked, of = [], class_model.group_unit
    monkeypatch.setattr(class_model, "OWN_UNITS", 1)
    monkeypatch.setattr(class_model, "group_unit", lambda w: asked.append(w) or of(w))
    vocabulary = class_model.Vocabulary([b"a", b"bb", b"ccc"])
    units = [vocabulary.units().tolist() for _ in range(3)]
    assert asked == [b"bb", b"ccc"]
    assert units == [[1, of(b"bb"), of(b"ccc"), *range(class_model.UNITS)]] * 3


def rhymes(seed):
    """Words of equal ending and length that stand alone, or between two others."""
    draw = random.Random(seed)
    stem = lambda: "".join(draw.choice(s) for s in ("bcdfgh", "aeiou", "klmnp", "rstvw"))
    kinds = {stem() + "ing": "xy"[k % 2] for k in range(300)}
    rows = []
    for k in range(2500):
        text = draw.choices(list(kinds), k=12)
        alone = [w for w in text if kinds[w] == "x"]
        rows.append((k, alone[0] if k % 10 and alone else " ".join(f"left {w} right" for w in text if kinds[w] == "y")))
    # frequent words of both kinds, and in all more frequent words than have units of their own
    rows += [(5000 + k, f"solo{k % 8}" if k % 2 else f"left mid{k % 8} right") for k in range(1200)]
    rows += [(9000 + k, " ".join(draw.sample([f"f{n}q" for n in range(class_model.OWN_UNITS)], class_model.OWN_UNITS))) for k in range(40)]
    return rows, kinds


@pytest.mark.parametrize("head", [10, 100_000])
def test_words_without_a_unit_move_by_themselves(documents, monkeypatch, head):
    """Words that are not among the most frequent share a unit by their ending, though half of them stand elsewhere."""
    rows, kinds = rhymes(5)
    monkeypatch.setattr(class_model, "HEAD", head)
    tables = []
    whole = class_model.word_classes
    monkeypatch.setattr(class_model, "word_classes", lambda *a: tables.append(whole(*a)) or tables[0])
    found = {r.doc_id: r for r in class_model.class_scores(documents(rows), is_held()).collect()}
    count = Counter(w for i, t in rows if not held(i) for w in t.split())
    table = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in tables[0].collect()}
    assert {w: n for w, (n, _) in table.items()} == dict(count)
    often = [w for w in kinds if count[w] >= 5]
    assert len(often) > 100
    classes = [Counter(table[w][1] for w in often if kinds[w] == k).most_common(1)[0] for k in "xy"]
    assert classes[0][0] != classes[1][0] and sum(n for _, n in classes) > 0.6 * len(often)
    # scores follow from the classes of the table, summed over texts word by word
    ends = sum(not held(i) for i, _ in rows)
    joint = np.zeros((class_model.CLASSES, class_model.CLASSES))
    paths = {i: [0, *(table[w][1] if w in table else -1 for w in t.split()), 0] for i, t in rows}
    for i, path in paths.items():
        if not held(i):
            np.add.at(joint, (path[:-1], path[1:]), 1)
    moves, size, once = class_model.transitions(joint), Counter(), Counter()
    for n, c in table.values():
        size[c] += n
        once[c] += n == 1
    unseen = {c: (once[c] + 0.5) / (size[c] + 1) for c in size}
    assert joint[:, 0].sum() == ends
    for i, text in rows:
        if -1 not in paths[i]:
            emitted = sum(math.log10((1 - unseen[c]) * n / size[c]) for n, c in (table[w] for w in text.split()))
            assert found[i].score == pytest.approx(emitted + sum(moves[a, b] for a, b in zip(paths[i], paths[i][1:])))


def test_scores_without_training_texts(documents):
    only = [(i, "a b") for i in range(60) if held(i)]
    assert len(only) > 3 and all(r.n_known == 0 for r in class_model.class_scores(documents(only), is_held()).collect())
    assert class_model.class_scores(documents([]), is_held()).collect() == []


# --- quality ------------------------------------------------------------------


def noisy(seed, count=160):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(count):
        good = k % 4 != 0
        words = ["".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(12, 60))]
        if not good:
            words = [w + draw.choice(["***", "$$$"]) for w in words] if k % 8 else [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_rules(spark, documents):
    rows, labels = noisy(1)
    odd = [(900, None), (901, ""), (902, "x\nx\n \nx " + "one two three four five " * 3), (903, "é#漢 <a|b> " + "q w e r t y u i o p")]
    docs = documents([*rows, *odd, odd[3]])
    table = spark.createDataFrame([*labels, labels[0], (5, None, 0), (None, 1, 0)], LABELS)
    model = quality_rules.train(docs, table)
    found = quality_rules.judge(docs, model).collect()
    assert len(found) == len(rows) + len(odd) + 1
    texts, good = dict([*rows, *odd]), {i: q for i, q, _ in labels}
    for r in found:
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times, cover = Counter(windows), set()
        for k, w in enumerate(windows):
            cover |= set(range(k, k + 5)) if times[w] > 1 else set()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (len(words) < 10 or 100 * len(cover) > 20 * len(words)) and not (r.base_failed and r.kept)
        assert r.doc_id not in good or r.kept == bool(good[r.doc_id])


def test_margins_are_sums_of_the_design():
    texts = [b"one two two three", b"", b"x", b"one one one one"]
    runs = Runs(words_of(pa.array(texts, pa.binary())))
    weights = np.random.default_rng(1).standard_normal(1 << quality_rules.BITS).astype(np.float32)
    model = quality_rules.Model(weights, 0.5, 1.0, 0.0)
    row, column, value = quality_rules.design(runs)
    direct = model.margins(runs, np.array(model.word_adds(runs.words.distinct)))
    assert direct == pytest.approx(np.bincount(row, weights=weights[column] * value, minlength=4) + 0.5, abs=1e-5)


def test_ranking(spark, documents):
    rows, labels = noisy(2)
    docs = documents([*rows, (900, None), (901, " "), (901, " ")]).selectExpr("*", "1 AS score", "2 AS quality")
    table = spark.createDataFrame([*labels, *labels[:5]], LABELS)
    ranker = ranking.train(docs, table)
    found = {r.doc_id: r.score for r in ranking.quality_scores(docs, ranker).collect()}
    assert len(found) == len(rows) + 2 and all(0 <= s <= 1 for s in found.values())
    good = {i: q for i, q, _ in labels}
    assert np.mean([(found[i] >= 0.3) == bool(q) for i, q in good.items()]) > 0.97
    again = ranking.with_scores(docs, ranker)
    assert again.columns == [*docs.columns, "tl_score"] and again.count() == docs.count()


def test_fits_without_both_labels_keep_everything(spark, documents):
    docs = documents([(k, "one two three four five six seven eight nine ten eleven") for k in range(4)])
    for rows in ([], [(0, 1, 0), (1, 1, 0)]):
        table = spark.createDataFrame(rows, LABELS)
        assert quality_rules.judge(docs, quality_rules.train(docs, table)).where("kept").count() == 4
        assert ranking.quality_scores(docs, ranking.train(docs, table)).where("score >= 0.3").count() == 4


def test_ranking_learns_from_all_labels(spark, documents, monkeypatch):
    rows = [(k, f"a{k} " * (k % 23 + 1) + "!" * (k % 5)) for k in range(9000)]
    table = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(9000)], LABELS)
    monkeypatch.setattr(ranking, "CHUNK", 1000)
    ranker = ranking.train(documents(rows), table)
    used = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5]
    whole = np.sqrt(ranking.features(pa.array([t for _, t in used])))
    assert len(used) > 7000 and ranker.mean == pytest.approx(whole.mean(axis=0), abs=1e-8)
    # the border is the quantile of all margins
    margin = (np.clip((whole - ranker.mean) / ranker.spread, -5, 5) * ranker.weights).sum(axis=1)
    share = sum(k % 3 == 0 for k, _ in used) / len(used)
    assert ranker.slope * np.quantile(margin, share) + ranker.shift == pytest.approx(np.log(0.3 / 0.7), abs=1e-6)


def test_a_rare_label_meets_every_chunk(spark, documents, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 20)
    rows, labels = noisy(4)
    table = spark.createDataFrame([x for x in labels if x[1] or x[0] < 60], LABELS)
    found = {r.doc_id: r.score for r in ranking.quality_scores(documents(rows), ranking.train(documents(rows), table)).collect()}
    good = {i: q for i, q, _ in labels}
    assert np.mean([(found[i] > 0.5) == bool(q) for i, q in good.items()]) > 0.9


# --- personal data ---------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BITS = [*"ab@.-+ ()123\n", "4567890", "_%", "é", "4111111111111111", "1.2.3.4", "@x.com", "+1 (555) 123-4567", "://", "token = ", "IBAN ", "٣", "255.", "007"]


def base_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(spans)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.finder().spans(text) if s[1] < pii.BASE] == base_spans(text)


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 is", "account", "DE89 3704 0044 0532 0130 00"),
        ("Account number: 12345678 and", "account", "12345678"),
        ("see https://user:pw@host.example.com/a?b=c. Next", "url", "https://user:pw@host.example.com/a?b=c"),
        ('api_key = "1eb9c654e721b4f8"', "secret", "1eb9c654e721b4f8"),
    ],
)
def test_added_spans(text, kind, value):
    assert value in [text[a:b] for a, k, b in pii.finder().spans(text) if pii.KINDS[k] == kind]


@pytest.mark.parametrize("text", ["the token of love", "accounting is fun", "a secret: none", "an account of 3 men", "http:// nothing"])
def test_plain_texts_have_no_added_spans(text):
    assert pii.finder().spans(text) == []


def test_personal_data_table(odd, documents):
    assert pii.personal_data(odd).where("spans = ''").count() == odd.count()
    text = "é a@b.co, 10.0.0.1 and 4111 1111 1111 1111\n+1 (555) 123-4567"
    (row,) = pii.personal_data(documents([(1, text)]).selectExpr("*", "1 AS spans", "2 AS n_ip")).collect()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.masked == "é [email], [ip] and [card]\n[phone]" and row.base == row.spans == "email:2:8,ip:10:18,card:23:42,phone:43:60"
    assert pii.personal_data(documents([])).collect() == []


# --- neighbours ----------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows, k, is_query):
    usable = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in usable.items():
        if is_query(i):
            scored = [(-(v * w).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())), j) for j, w in usable.items() if j != i]
            out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    draw = np.random.default_rng(1)
    rows = [(k, draw.standard_normal(32).astype(np.float32).tolist(), 0) for k in range(1500)]
    rows += [(k, rows[20][1], 0) for k in range(1500, 1540)]
    found = {}
    for r in sorted(ann.nearest(vectors(spark, rows), "vec_id % 20 = 0", k=5).collect()):
        found.setdefault(r.query_id, []).append(r.vec_id)
    wanted = exact(rows, 5, lambda i: i % 20 == 0)
    hits = sum(len({*found[q]} & {*w}) for q, w in wanted.items())
    assert hits / sum(map(len, wanted.values())) > 0.97
    assert found[20] == [1500, 1501, 1502, 1503, 1504]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.5], 0), (1, [1.0, 1.0], 0)]
    bad = [(3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (None, [1.0, 0.0], 0), (9, [1.0], 0)]
    table = vectors(spark, good + bad).selectExpr("*", "1 AS rank", "2 AS score", "3 AS code")
    found = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table, "vec_id % 2 = 0", k=5).collect()]
    assert sorted(found) == [(0, 1, 1), (0, 2, 1), (0, 3, 2), (2, 1, 1), (2, 2, 1), (2, 3, 0)]
    assert ann.nearest(vectors(spark, []), "vec_id % 2 = 0").collect() == []


def test_bounds_hold_for_most_pairs():
    draw = np.random.default_rng(2)
    own, asked = draw.standard_normal((500, 48)), draw.standard_normal((20, 48))
    turned = ann.unit(own) @ ann.rotation(48)
    scale = np.abs(turned).sum(axis=1) / np.sqrt(48)
    estimate = (ann.unit(asked) @ ann.rotation(48)) @ np.sign(turned).T / np.sqrt(48) / scale
    bound = ann.ERROR * np.sqrt(1 - scale**2) / scale / np.sqrt(47)
    assert (np.abs(estimate - ann.unit(asked) @ ann.unit(own).T) <= bound).mean() > 0.99


def test_hash_of_masked_text_is_stable():
    assert hashlib.sha256(pii.masked("a@b.co", [(0, 0, 6)]).encode()).hexdigest() == hashlib.sha256(b"[email]").hexdigest()
