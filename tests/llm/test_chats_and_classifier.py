"""Chat formatting against SQL and a plain state machine; the classifier against a plain walk and held-out labels."""

import os

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import op6_chat_format as op6
from loomgraph.llm import op10_quality_classifier as op10
from loomgraph.llm.kernels import Texts
from tests.compare import assert_same

from .brute import leaf_of, prose, statistics, trees

SF = "/root/testdata/sf0.1"

CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "system", "be brief"), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (2, 2, "assistant", "b"),
    (3, 0, "assistant", "first"), (4, 0, "user", "open"), (5, None, "user", "x"), (5, 1, "assistant", "y"), (6, 0, "user", "x"), (6, 0, "user", "y"), (6, 1, "assistant", "z"),
    (7, 0, None, "x"), (8, 0, "tool", "x"), (9, 0, "user", None), (9, 1, "assistant", ""), (10, 3, "assistant", "later"), (10, -2, "user", "long " * 50_000), (None, 0, "user", "lost"),
    (11, 0, "user", "a"), (11, 1, "user", "b"), (11, 2, "assistant", "c"), (12, 0, "system", "only"), (13, 0, "user", "a"), (13, 1, "assistant", "b"), (13, 2, "system", "late"), (13, 3, "user", "c"), (13, 4, "assistant", "d"),
]


def chats(spark):
    return spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string")


def test_odd_chats_equal_sql(spark, tmp_path):
    df = chats(spark)
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    f = next(x for x in os.listdir(f"{tmp_path}/c") if x.endswith(".parquet"))
    os.makedirs(f"{tmp_path}/sf")
    os.rename(f"{tmp_path}/c/{f}", f"{tmp_path}/sf/conversations.parquet")
    assert_same(op6.format_chats(df), op6.ORACLE, f"{tmp_path}/sf")


def test_odd_chats_equal_a_plain_machine(spark):
    more = chats(spark).selectExpr("*", "1 AS turns", "2 AS error", "3 AS p", "4 AS segment")
    found = {}
    for r in op6.format_chats(more).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert set(found) == {c for c, *_ in CHATS if c is not None}
    for conv, rows in found.items():
        turns = sorted({c[1:] for c in CHATS if c[0] == conv}, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        state, error = op6.CHATML.start, None
        for _, role, _ in turns:
            state = op6.CHATML.moves.get(state, {}).get(role)
        numbers = [t[0] for t in turns]
        error = "turn missing" if None in numbers else "turn repeated" if len(set(numbers)) < len(numbers) else "turn order" if state is None else None if state in op6.CHATML.ends else "unfinished"
        assert {r.error for r in rows} == {error}
        if error:
            assert len(rows) == 1 and rows[0].text is None
            continue
        rows.sort(key=lambda r: r.segment)
        assert [r.segment for r in rows] == list(range(3 * len(turns)))
        assert "".join(r.text for r in rows) == "".join(f"<|im_start|>{role}\n{text or ''}<|im_end|>\n" for _, role, text in turns)
        assert [r.loss for r in rows] == [x for _, role, _ in turns for x in (False, role == "assistant", role == "assistant")]
    assert op6.format_chats(more.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1, 10])
def test_long_conversations_are_judged_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(op6, "CHUNK", chunk)
    role = lambda k: "user" if k % 2 == 0 else "assistant"
    rows = [(1, k, role(k), f"t{k}") for k in range(-1024, 3000)] + [(2, k, role(k), "x") for k in range(2999)] + [(3, k, "user" if k == 1701 else role(k), "x") for k in range(3000)]
    rows += [(4, 0, "user", "same")] * 500 + [(4, 7, "assistant", f"other {k}") for k in range(500)] + [(5, 0, "user", "same")] * 500 + [(5, 9000, "assistant", "end")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    found: dict = {}
    for r in op6.format_chats(df).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert {c: {r.error for r in x} for c, x in found.items()} == {1: {None}, 2: {"unfinished"}, 3: {"turn order"}, 4: {"turn repeated"}, 5: {None}}
    one = sorted(found[1], key=lambda r: r.segment)
    assert [r.segment for r in one] == list(range(3 * 4024)) and [r.text for r in one[1::3]] == [f"t{k}" for k in range(-1024, 3000)]
    assert [(r.turn, r.text) for r in sorted(found[5], key=lambda r: r.segment)[1::3]] == [(0, "same"), (9000, "end")]


def test_another_template(spark):
    plain = op6.Template({"s": {"q": "a"}, "a": {"r": "s"}}, "s", ("s",), "[", "]", ("r",), learn_tail=False)
    df = spark.createDataFrame([(1, 0, "q", "x"), (1, 1, "r", "y")], "conv_id int, turn int, role string, text string")
    assert [(r.text, r.loss) for r in op6.format_chats(df, plain).orderBy("segment").collect()] == [("[", False), ("x", False), ("]", False), ("[", False), ("y", True), ("]", False)]


def test_roles_are_filled_in_everywhere(spark):
    both = op6.Template({"s": {"q": "a"}, "a": {"r": "s"}}, "s", ("s",), "<{role}>{role}:", "</{role}>", ("r",))
    df = spark.createDataFrame([(1, 0, "q", "{role}"), (1, 1, "r", "y")], "conv_id int, turn int, role string, text string")
    parts = op6.format_chats(df, both).orderBy("segment").collect()
    assert "".join(r.text for r in parts) == "<q>q:{role}</q><r>r:y</r>"
    odd = df.selectExpr("conv_id AS `a.b`", "turn AS `t.t`", "role", "text")
    assert op6.format_chats(odd, both, conv_col="a.b", turn_col="t.t").count() == 6


def test_trees_equal_plain_ones():
    rng = np.random.default_rng(18)
    x = np.round(rng.normal(size=(90, 3)), 1)  # ties
    y = ((x[:, 0] + x[:, 2] > 0.2) ^ (rng.random(90) < 0.1)).astype(float)
    base, plain = trees(x, y, 4, 3, 8)
    found = op10.train(x, y, trees=4, depth=3, bins=8)
    want = [1 / (1 + np.exp(-(base + sum(leaf_of(t, row) for t in plain)))) for row in x]
    assert np.allclose(found.score(x), want)


def test_statistics_equal_plain_ones():
    own = [None, "", " ", "a b c.", "ÄÖ\n123 !!  x--y", "x" * 5000, "word " * 300, "\n\n", "Ein ein Ein, [x] {y}\tz 42 42 42", prose(np.random.default_rng(19), 300)]
    for text, row in zip(own, op10.statistics(Texts.of(pa.array(own)))):
        assert dict(zip(op10.FEATURES, row)) == pytest.approx(statistics(text)), text


def test_training_rows_are_bounded_and_the_same_in_any_order(spark):
    rng = np.random.default_rng(20)
    docs = [(i, prose(rng, 20 + i % 50), k) for i in range(60) for k in range(8)]  # each labelled document eight times, with other texts
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1)], "doc_id bigint, quality int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, k int")
    fits = [op10.fit(df.repartition(n).sortWithinPartitions(how), labels, max_train=40) for n, how in ((1, "k"), (5, "text"))]
    assert (fits[0].feature == fits[1].feature).all() and np.allclose(fits[0].value, fits[1].value) and fits[0].base == fits[1].base
    n = op10.fit(df, labels.where("doc_id < 10"), max_train=40)
    assert n.base == pytest.approx(np.log(6.5 / 5.5))  # eleven labels, six of them 1


def test_flat_trees_equal_a_plain_walk_and_the_first_split_is_the_best():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 1] > 0.3) ^ (rng.random(600) < 0.1)).astype(float)
    t = op10.train(x, y, trees=8, depth=3, bins=32)

    def walk(row):
        total = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [walk(r) for r in x])
    p = y.mean()
    base = (y.sum() + 0.5) / (len(y) + 1)
    g, h = base - y, np.full(len(y), base * (1 - base))
    gain = {}
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])):
            left = x[:, f] <= cut
            gain[f, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + op10.RIDGE) for s in (left, ~left))
    best = max(gain, key=gain.get)
    assert (t.feature[t.roots[0]], t.threshold[t.roots[0]]) == best
    assert ((t.score(x) >= 0.5) == (x[:, 1] > 0.3)).mean() > 0.95 and 0 < p < 1


def test_statistics_do_not_depend_on_the_batch():
    own = [None, "", "a b c.", "ÄÖ\n123 !!", "x" * 5000, "word " * 300, "\n\n"]
    whole = op10.statistics(Texts.of(pa.array(own)))
    alone = np.concatenate([op10.statistics(Texts.of(pa.array([t], pa.string()))) for t in own])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()
    named = dict(zip(op10.FEATURES, whole[5]))
    assert named["distinct_words"] == pytest.approx(1 / 300) and named["same_as_before"] == pytest.approx(299 / 300)


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "z"), (None, None, None), (2, "", "z"), (2, "", "z"), (3, "long " * 90_000, None)], "doc_id bigint, text string, y string")
    kind = "doc_id bigint, quality int, toxic int"
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (77, 1, 1)]):
        out = op10.classify(docs, spark.createDataFrame(labels, kind)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.keep == (r.score >= op10.CUT) for r in out)
        if not labels:
            assert all(r.score == 0.5 and r.keep for r in out)
    assert op10.classify(docs.limit(0), spark.createDataFrame([], kind)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_accuracy_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 4 = 0")
    out = op10.classify(docs, labels.where("doc_id % 4 <> 0")).join(held, "doc_id").select("quality", "keep", "score").toPandas()
    right = ((out.quality > 0) == out.keep).mean()
    assert len(out) > 200 and right > 0.9, right
