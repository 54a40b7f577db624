"""Source mixing against a plain loop, and its odd cases."""

import re
from collections import defaultdict
from fractions import Fraction
from hashlib import md5

import pytest

from tickloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, rate string, copies int"


def brute(rows, weights=(5, 2, 1), share=Fraction(3, 2), most=2, draws=mixing.DRAWS):
    """(doc_id, size, source words, target, copies) of (doc_id, text, source) rows."""
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    words = defaultdict(int)
    for _, n, s in sized:
        words[s] += n
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(words, key=lambda s: (s is None, (s or "").encode())))}
    target, free = {}, set(words)
    while free:
        level = (share * sum(words.values()) - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > most * words[s]}
        if not above:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: Fraction(most * words[s]) for s in above}
        free -= above

    def draw(i, seed):
        text = md5(f"{'' if i is None else i}:{seed // 4}".encode()).hexdigest()
        return int(text[seed % 4 * 8 :][:8], 16) / 2**32

    out = []
    for s in words:
        rate = float(target[s]) / words[s] if words[s] else 0.0
        tried = []
        for seed in range(draws):
            own = [(i, n, words[s], float(target[s]), int(rate) + (draw(i, seed) < rate - int(rate))) for i, n, t in sized if t == s]
            tried.append((abs(sum(n * c for _, n, _, _, c in own) - float(target[s])), seed, own))
        out += min(tried, key=lambda t: t[:2])[2]
    return out


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "other", 7) for i, t, s in rows], SCHEMA).repartition(3)


CASES = {
    "usual": [(i, "w " * (1 + i * 7 % 40), f"s{i % 7}") for i in range(300)],
    "one source": [(i, "a b c", "x") for i in range(50)],
    "one hot source": [(i, "a b c d", "x" if i % 3 else f"y{i}") for i in range(120)],
    "odd": [
        (1, "a b", "é"), (1, "a b", "é"), (2, None, "é"), (3, "", "empty"), (4, " \t\n", "empty"), (5, "x\x1cy z\x85", None),
        (None, "no id", "z"), (None, "no id", "z"), (6, "long " * 50_000, "long"), (7, "one", None), (8, "a", ""),
    ],
    "no words": [(1, "", "a"), (2, None, "b")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("salted", [False, True])
def test_plan_equals_brute_force(spark, monkeypatch, name, salted):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = CASES[name]
    found = mixing.mix_plan(rows_of(spark, rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[4])
    got = sorted([(r.doc_id, r.size, r.source_size, r.target, r.copies) for r in found], key=key)
    wanted = sorted(brute(rows), key=key)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in wanted]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in wanted], rel=1e-12)


def test_targets_are_met_and_capped(spark):
    rows = CASES["usual"]
    found = mixing.mix_plan(rows_of(spark, rows)).collect()
    total = sum(r.size for r in found)
    assert sum({r.source_size: r.target for r in found}.values()) == pytest.approx(1.5 * total)
    assert all(r.copies <= 2 and r.target <= 2 * r.source_size for r in found)
    for words in {r.source_size for r in found}:
        own = [r for r in found if r.source_size == words]
        assert sum(r.size * r.copies for r in own) == pytest.approx(own[0].target, rel=0.02)


def test_the_mix_keeps_columns_and_repeats_rows(spark):
    rows = CASES["odd"]
    docs = rows_of(spark, rows)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == [*docs.columns, "copy"] and {r.copies for r in mix.collect()} == {7}
    wanted = sum(r.copies for r in mixing.mix_plan(docs).collect())
    assert mix.count() == wanted > 0
    with pytest.raises(ValueError):
        mixing.mixed_documents(docs.withColumnRenamed("rate", "Copy"))


def test_runs_agree_and_empty_tables(spark):
    docs = rows_of(spark, CASES["usual"])
    plans = [sorted(mixing.mix_plan(d).collect()) for d in (docs, docs.repartition(7))]
    assert plans[0] == plans[1]
    assert mixing.mix_plan(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []


def test_a_share_that_cannot_be_reached(spark):
    with pytest.raises(ValueError):
        mixing.mix_plan(rows_of(spark, CASES["usual"]), share=(5, 2))


def test_the_main_path_has_no_python_work(spark):
    plan = mixing.mix_plan(rows_of(spark, CASES["usual"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
