"""Sharding against SQL and a plain filling of the table; mixing against multipliers by bisection."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import op3_sharding as op3
from loomgraph.llm import op4_mixing as op4
from tests.compare import assert_same

from .brute import mixing, prose, tokens_of


def test_table_is_filled_in_turns():
    names, slots = ("a", "b", "c", "d", "e"), 101
    wishes = [[(op3._hash(s, "offset") + k * (op3._hash(s, "step") % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
    assert all(sorted(w) == list(range(slots)) for w in wishes)
    owner: dict = {}
    while len(owner) < slots:
        for i, w in enumerate(wishes):
            if len(owner) < slots:
                owner[next(x for x in w if x not in owner)] = i
    assert op3.lookup_table(names, slots) == [owner[k] for k in range(slots)]


def test_shares_are_even_and_a_lost_shard_moves_little():
    full = op3.lookup_table()
    shares = Counter(full).values()
    assert max(shares) - min(shares) <= 1
    less = op3.lookup_table(op3.SHARDS[:-1])
    last = len(op3.SHARDS) - 1
    moved = sum(a != b for a, b in zip(full, less) if a != last)
    assert moved < 0.1 * op3.SLOTS


@pytest.mark.parametrize("shards, slots", [((), 7), (("a", "a"), 7), (("a",), 8), (("a", "b", "c"), 2)])
def test_bad_parameters_are_refused(shards, slots):
    with pytest.raises(ValueError):
        op3.lookup_table(shards, slots)


def test_placement_equals_sql_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 5), (None, None, None), (1, "y", 6), (-7, "", 7), (2**62, "z", 8)], "doc_id bigint, text string, shard int")
    df.select("doc_id").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    path = f"{tmp_path}/documents.parquet/{next(f for f in os.listdir(f'{tmp_path}/documents.parquet') if f.endswith('.parquet'))}"
    assert_same(op3.place(df.select("doc_id")), op3.oracle().replace("FROM documents", f"FROM '{path}'"), "/root/testdata/sf0.001")
    placed = op3.place(df)
    assert placed.columns == ["doc_id", "text", "shard", "slot"] and placed.count() == 5
    assert op3.place(df.limit(0)).count() == 0
    op3.write_shards(df.select("doc_id", "text"), f"{tmp_path}/out", shards=("a", "b", "c"), slots=13)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 5 and back.select("shard").distinct().count() <= 3


def documents() -> list:
    rng = np.random.default_rng(11)
    docs = [(i, prose(rng, int(rng.geometric(0.02))), ["web", "web", "web", "book", None][int(rng.integers(0, 5))]) for i in range(300)]
    return docs + [(1000, None, "web"), (1001, "", "book"), (None, "one two", "web"), (1002, " a\t\nb  c ", "void"), docs[7], (1003, "x " * 5000, "book")]


def key(r):
    return str(r[0]), round(r[1], 6)


@pytest.mark.parametrize("few", [op4.FEW, 1])
def test_rates_equal_bisection_and_meet_the_targets(spark, monkeypatch, few):
    monkeypatch.setattr(op4, "FEW", few)  # with 1, the way of very many sources
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3)
    found = sorted([tuple(r) for r in op4.copies(df).collect()], key=key)
    want = sorted(mixing(docs, op4.FLATTEN), key=key)
    assert [r[0] for r in found] == [r[0] for r in want] and [r[2] for r in found] == [r[2] for r in want]
    assert np.allclose([r[1] for r in found], [r[1] for r in want], rtol=1e-6)
    text = {d[0]: d for d in docs}
    got, have = defaultdict(float), defaultdict(float)
    for i, rate, _ in found:
        got[text[i][2]] += rate * tokens_of(text[i][1])
        have[text[i][2]] += tokens_of(text[i][1])
    weight = {s: (h / sum(have.values())) ** op4.FLATTEN for s, h in have.items() if h}
    goal = {s: max(have[x] / weight[x] for x in weight) * w for s, w in weight.items()}
    assert all(got[s] == pytest.approx(goal[s], rel=1e-6) for s in goal)
    assert all(r[1] >= 1 - 1e-9 for r in found)  # no document is lost
    assert sum(r[2] for r in found) == pytest.approx(sum(r[1] for r in found), rel=0.05)


def test_given_weights(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    found = {r.doc_id: r.copies for r in op4.copies(df, {"web": 1, "book": 3, None: 0}, total=50_000).collect()}
    source = {d[0]: d[2] for d in docs}
    assert all(n == 0 for i, n in found.items() if source[i] is None or i == 1002)
    assert found[1000] == 1 and found[1001] == 1  # without tokens


def test_targets_however_far_are_met_or_refused(spark, monkeypatch):
    docs = [(1, "one", "tiny"), *[(k, "x " * (k % 7 * 900 + 1), "big") for k in range(2, 60)]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    for weights, total in (({"tiny": 1, "big": 1e-9}, 1e12), ({"tiny": 1, "big": 1}, 1e-30), ({"tiny": 1e-200, "big": 1}, 3e5)):
        whole = sum(weights.values())
        got = defaultdict(float)
        for r in op4.copies(df, weights, total).collect():
            got[docs[r.doc_id - 1][2]] += r.rate * tokens_of(docs[r.doc_id - 1][1])
        for s, w in weights.items():
            assert got[s] == pytest.approx(total * w / whole, rel=1e-6), (s, total)
    monkeypatch.setattr(op4, "ITERATIONS", 2)
    with pytest.raises(RuntimeError, match="2 steps"):
        op4.copies(df, {"tiny": 1, "big": 1}, 1e7)


def test_mix_repeats_rows_and_keeps_odd_columns(spark):
    docs = [(*d, k) for k, d in enumerate(documents())]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n int").selectExpr("doc_id", "text", "source", "n AS rate", "n AS `row`", "n AS `__copies`", "n AS copies", "n AS `a.b`")
    out = op4.mix(df)
    assert out.columns == df.columns
    assert op4.mix(df.withColumnRenamed("doc_id", "my.id").withColumnRenamed("text", "t.x"), id_col="my.id", text_col="t.x").count() == out.count()
    got = Counter(r["row"] for r in out.select("row").collect())
    assert [got[k] for k in range(len(docs))] == [n for _, _, n in mixing([d[:3] for d in docs], op4.FLATTEN)]
    assert op4.mix(df.limit(0)).count() == 0 and op4.copies(df.limit(0)).count() == 0
