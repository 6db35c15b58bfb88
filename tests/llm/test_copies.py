"""Exact and near dedup against plain versions, and planted copies."""

import time

import numpy as np
import pyarrow as pa

from loomgraph.llm import op5_simhash as op5
from loomgraph.llm import op9_exact_dedup as op9
from loomgraph.llm.kernels import Texts, Words, hashes, mix

from .brute import near_copies, prose


def corpus(rng: np.random.Generator) -> tuple[list, dict]:
    """Documents, and the least of its group for each planted copy."""
    docs, planted = [], {}
    for i in range(0, 60 * 4, 4):
        words = prose(rng, int(rng.integers(120, 400))).split(" ")
        docs.append((i, " ".join(words)))
        if i % 3 == 0:
            near = list(words)
            near[int(rng.integers(0, len(near)))] = "changed"
            docs += [(i + 1, " ".join(near)), (i + 2, " ".join(words).upper())]
            planted |= {i + 1: i, i + 2: i}
    return docs, planted


def test_fingerprints_are_majorities_of_word_hashes():
    text = "Der Käfer, der KÄFER und die 3 Mäuse"
    words = ["der", "käfer", "der", "käfer", "und", "die", "3", "mäuse"]
    hashed = lambda w: hashes(d := np.frombuffer(w.encode(), np.uint8), Words(np.array([0]), np.array([len(d)]), np.array([0])))
    other = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        each = [hashed(w) for w in words]
        once = [mix((h >> np.uint64(20)) + np.uint64(1)) for h in {int(h[0]): h for h in each}.values()]
        lists = [each, [mix(h + other) for h in each], once, [mix(h + other) for h in once]]
    wanted = [sum(1 << k for k in range(64) if 2 * sum(int(h[0]) >> k & 1 for h in own) > len(own)) for own in lists]
    assert op5.fingerprints(Texts.of(pa.array([text])))[1].tolist() == [wanted]
    own = [int(hashes(d := np.frombuffer(w.encode(), np.uint8), Words(np.array([0]), np.array([len(d)]), np.array([0])))[0]) for w in words]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own))
    doc, f = op5.fingerprints(Texts.of(pa.array([None, "", "?!", text, "other"])))
    assert doc.tolist() == [3, 4] and int(f[0, 0]) == want


def plain_majority(features: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    ones = np.add.reduceat(np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1), start, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > count[:, None], axis=1).view(np.uint64).ravel()


def test_majorities_of_runs_of_any_length():
    """Runs round the borders of a stretch, of equal features too, and ties."""
    rng = np.random.default_rng(41)
    count = np.array([1, 2, 254, 255, 256, 509, 510, 511, 70_000, 3, 1])
    start = np.cumsum(count) - count
    features = rng.integers(0, 2**64, count.sum(), dtype=np.uint64)
    for f in (features, np.full_like(features, 2**64 - 1), np.where(np.arange(len(features)) % 2, features[0], ~features[0])):
        assert op5._majority(f, start, count).tolist() == plain_majority(f, start, count).tolist()


def test_fingerprints_cost_less_than_counting_bit_by_bit():
    """Four fingerprints and all else take less than plain counts of the first two would."""
    rng = np.random.default_rng(42)
    texts = Texts.of(pa.array([prose(rng, 400) for _ in range(1000)]))
    features = rng.integers(0, 2**64, 1000 * 400, dtype=np.uint64)
    start, count = np.arange(0, len(features), 400), np.full(1000, 400)

    def seconds(f, *args) -> float:
        began = time.thread_time()
        f(*args)
        return time.thread_time() - began

    ours, plain = (min(seconds(*x) for _ in range(5)) for x in ((op5.fingerprints, texts), (plain_majority, features, start, count)))
    print("seconds of fingerprints and of plain counts of one of them:", ours, plain)
    assert ours < 1.6 * plain


def test_tree_finds_every_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64)), base[:9], rng.integers(0, 2**63, 900, dtype=np.uint64)])
    for radius in (0, 4, 24):
        found = {(int(a), int(b)) for x, y in op5.Tree(points, leaf=8).within(points, radius) for a, b in zip(x, y)}
        far = np.bitwise_count(points[:, None] ^ points[None, :])
        assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= radius))}


def test_shards_lose_no_pair():
    rng = np.random.default_rng(7)
    points = rng.integers(0, 2**16, 600, dtype=np.uint64)  # crowded: many pairs across borders
    shards = op5.Shards(points[::7], 9)
    i, s, asks = shards.spread(points, 3)
    at = [set() for _ in range(len(shards))]
    home = {}
    for p, k, q in zip(i.tolist(), s.tolist(), asks.tolist()):
        at[k].add(p)
        if not q:
            assert home.setdefault(p, k) == k
    assert len(home) == len(points)
    for a in range(600):
        for b in range(a):
            if (int(points[a]) ^ int(points[b])).bit_count() <= 3:
                assert any(a in x and b in x and k in (home[a], home[b]) for k, x in enumerate(at))


def test_slices_of_a_shard_lose_no_pair(spark, monkeypatch):
    """Small bounds give many shards and slices; groups are those of all pairs."""
    monkeypatch.setattr(op5, "SHARD_POINTS", 40)
    monkeypatch.setattr(op5, "TASK_ROWS", 30)
    docs, _ = corpus(np.random.default_rng(21))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.duplicate_of for r in op5.near_copies(df, shards=2).collect()} == near_copies(docs)
    rng = np.random.default_rng(22)
    points = rng.integers(0, 2**16, 500, dtype=np.uint64)
    plan = op5.Plan(points[::3], 500, 3, 2)
    assert len(plan.shards) >= 12 and plan.slices.max() > 1 and plan.end == plan.slices.sum() == len(plan.slice_of())
    node = np.arange(500)
    i, task, asks = plan.place(points, node, 3)
    met = set()
    for k, (part, of) in enumerate(plan.slice_of()):
        own, other = i[(task == k) & (asks == 0)], i[(task == k) & (asks == 1)]
        met |= {frozenset((int(a), int(b))) for a in own for b in own if a % of == part} | {frozenset((int(a), int(b))) for a in own for b in other}
    assert all(frozenset((a, b)) in met for a in range(500) for b in range(a) if (int(points[a]) ^ int(points[b])).bit_count() <= 3)


def test_rows_sent_for_a_point_are_bounded():
    """Uniform fingerprints, the worst case: rows sent grow with the shards, which grow only with what a task can't hold."""
    points = np.random.default_rng(23).integers(0, 2**63, 20_000, dtype=np.uint64)
    sent = {}
    for shards in (24, 240, 2400):
        plan = op5.Plan(points, 0, op5.RADIUS, shards)
        sent[len(plan.shards)] = plan.sent
    print("rows sent for each point, by shards of a tree:", sent)
    assert all(n <= 0.6 * shards for shards, n in sent.items())
    for total in (10**4, 10**6, 4 * 10**7):  # about 100 GB of documents: still the least number of shards
        plan = op5.Plan(points, total, op5.RADIUS)
        assert len(plan.shards) <= 40 and plan.sent <= 20
    assert len(op5.Plan(points, 10**9, op5.RADIUS).shards) <= 1000


def test_pieces_lose_no_pair(monkeypatch):
    """For each radius, crowded fingerprints at all distances round it, in many buckets: groups are those of all pairs."""
    monkeypatch.setattr(op5, "BUCKET", 1)
    rng = np.random.default_rng(31)
    for most in (0, 1, 2, 3, 7, 12, 24, 31):
        base = rng.integers(0, 2**64, (60, 4), dtype=np.uint64)
        rows = [base]
        for flips in (most // 2, most, most + 1):
            copy = base.copy()
            for k in range(len(copy)):
                for bit in rng.choice(128, flips, replace=False).tolist():
                    copy[k, 2 + bit // 64] ^= np.uint64(1 << bit % 64)
            rows.append(copy)
        f = np.unique(np.concatenate(rows), axis=0)
        f[::5, :2] = ~f[::5, :2]  # of those the first two fingerprints are far
        own = op5.pieces(most)
        assert len(own) == most + 1
        edges, met = [], 0
        for p in own:
            shard = p.shard(f[:, 2 + p.half])
            for k in np.unique(shard):
                at = np.flatnonzero(shard == k)
                search = op5.PieceSearch(p, f[at, :2].T, f[at, 2:].T, at, 8, most)
                edges += zip(*(x.tolist() for x in search.edges()))
                met += search.compared
        far = np.bitwise_count(f[:, None] ^ f[None, :]).astype(int)
        a, b = np.nonzero((far[:, :, 2:].sum(axis=2) <= most) & (far[:, :, :2].min(axis=2) <= 8))
        label = op5._joined(np.arange(len(f)), a, b)
        one, other = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
        assert (op5._joined(np.arange(len(f)), one, other) == label).all()
        assert met and (most == 0 or len(np.unique(label)) < len(f))


def test_near_halves_are_looked_at_many_at_a_time(monkeypatch):
    """A few near halves in each part of the comparison wait for each other; groups are those of all pairs."""
    rng = np.random.default_rng(43)
    f = rng.integers(0, 2**64, (1300, 4), dtype=np.uint64)
    f[:, 2] &= ~np.uint64(63)  # one shard of the first piece
    near = rng.permutation(1300)[:600].reshape(300, 2)
    f[near[:, 0]] = f[near[:, 1]] ^ (np.uint64(1) << rng.integers(6, 64, (300, 4)).astype(np.uint64))
    calls, take = [], op5.PieceSearch._take
    monkeypatch.setattr(op5.PieceSearch, "_take", lambda self, a, b: calls.append(len(a)) or take(self, a, b))
    piece = op5.pieces(op5.SET_RADIUS)[0]
    monkeypatch.setattr(piece, "errors", piece.rest)  # every bucket meets every other
    search = op5.PieceSearch(piece, f[:, :2].T, f[:, 2:].T, np.arange(1300), op5.RADIUS, op5.SET_RADIUS)
    far = np.bitwise_count(f[:, None] ^ f[None, :]).astype(int)
    a, b = np.nonzero((far[:, :, 2:].sum(axis=2) <= op5.SET_RADIUS) & (far[:, :, :2].min(axis=2) <= op5.RADIUS))
    assert (op5._joined(np.arange(1300), *search.edges()) == op5._joined(np.arange(1300), a, b)).all()
    assert search.compared > 1 << 19 and sum(calls) >= 300 and len(calls) == 1


def test_rows_sent_by_pieces_follow_from_the_radius_alone():
    """One row for each piece, to a shard of that piece, whatever the number of points."""
    own = op5.pieces(op5.SET_RADIUS)
    assert len(own) == op5.SET_RADIUS + 1 and own[0].first == 0 and all(p.end == q.first for p, q in zip(own, own[1:]))
    for n in (10, 10_000):
        halves = np.random.default_rng(34).integers(0, 2**64, n, dtype=np.uint64)
        for p in own:
            shard = p.shard(halves)
            assert shard.shape == (n,) and shard.min() >= p.first and shard.max() < p.end


def test_share_of_pairs_compared_falls_as_the_points_grow():
    """Texts of one language have like counts of words, all within RADIUS here; their sets keep them apart, and better the more there are."""
    rng = np.random.default_rng(32)
    share = {}
    for n in (100_000, 800_000):
        sets = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        tops, compared = np.zeros_like(sets), 0
        own = op5.pieces(op5.SET_RADIUS)
        for p in own:
            at = np.flatnonzero(p.shard(sets[p.half]) == p.first + 1)
            compared += op5.PieceSearch(p, tops[:, at], sets[:, at], at, op5.RADIUS, op5.SET_RADIUS).compared * (p.end - p.first)
        share[n] = compared / (n**2 / 2)
    print("share of all pairs that are compared, by points:", share)
    assert share[100_000] < 0.5 and share[800_000] < 0.5 * share[100_000]


def test_either_search_finds_the_groups_of_all_pairs(spark, monkeypatch):
    docs, _ = corpus(np.random.default_rng(33))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = lambda: {r.doc_id: r.duplicate_of for r in op5.near_copies(df, shards=3).collect()}
    wanted = near_copies(docs)
    monkeypatch.setattr(op5, "PIECE_ROWS", 500)
    assert found() == wanted and wanted
    monkeypatch.setattr(op5, "BLOCK_RADIUS", 23)
    monkeypatch.setattr(op5, "pieces", None)  # not asked
    monkeypatch.setattr(op5, "SHARD_POINTS", 40)
    monkeypatch.setattr(op5, "TASK_ROWS", 30)
    assert found() == wanted


def test_ids_of_other_types(spark):
    docs, _ = corpus(np.random.default_rng(24))
    own = [(f"d{i:04d}", t) for i, t in docs[:60]]
    df = spark.createDataFrame(own, "`my.id` string, text string")
    found = {r.doc_id: r.duplicate_of for r in op5.near_copies(df, id_col="my.id").collect()}
    assert found == {f"d{a:04d}": f"d{b:04d}" for a, b in near_copies(docs[:60]).items()} and found
    kept = op5.drop_near_copies(df, id_col="my.id")
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == sorted(i for i, _ in own if i not in found)


def test_near_copies_equal_brute_force_and_hold_the_planted(spark):
    docs, planted = corpus(np.random.default_rng(8))
    docs += [(1000, None), (1001, ""), (None, docs[0][1]), docs[3], (2000, docs[3][1]), (2001, "日本語" * 90), (2002, "日本語" * 90 + "だ"), (2003, "one"), (2004, "one")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for shards in (1, 24):
        found = {r.doc_id: r.duplicate_of for r in op5.near_copies(df, shards=shards).collect()}
        assert found == near_copies(docs)
    caught = [i for i in planted if found.get(i) == planted[i]]
    assert len(caught) >= 0.95 * len(planted)
    assert not [i for i in found if i < 1000 and i not in planted]  # clean documents are left alone
    kept = [r.doc_id for r in op5.drop_near_copies(df).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in docs if i not in found)


def test_short_texts_with_some_words_edited_are_near(spark):
    rng = np.random.default_rng(10)
    docs, planted = [], {}
    for i in range(0, 2 * 240, 2):
        words = [f"w{int(k)}" for k in rng.integers(0, 3000, int(rng.integers(50, 201)))]
        near = list(words)
        share = rng.uniform(0.03, 0.1)
        for at in rng.choice(len(near), max(1, round(share * len(near))), replace=False):
            near[at] = f"edit{int(rng.integers(10**6))}"
        docs += [(i, " ".join(words)), (i + 1, " ".join(near))]
        planted[i + 1] = (i, share)
    found = {r.doc_id: r.duplicate_of for r in op5.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == near_copies(docs)
    caught = lambda most: np.mean([found.get(k) == i for k, (i, share) in planted.items() if share <= most])
    assert caught(0.06) >= 0.95 and caught(0.1) >= 0.8
    assert not [i for i in found if i not in planted]


def test_rows_that_share_a_doc_id_are_dropped_one_by_one(spark):
    rng = np.random.default_rng(11)
    a, b, c = (" ".join(f"w{int(k)}" for k in rng.integers(0, 3000, 150)) for _ in range(3))
    rows = [(1, a), (5, a + " more"), (5, b), (5, None), (9, b + " more"), (9, c), (9, c)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.duplicate_of) for r in op5.near_copies(df).collect()} == {(5, 1), (9, 5)}
    kept = sorted(map(tuple, op5.drop_near_copies(df).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (5, None), (9, c), (9, c)], key=str)


def test_thousands_of_copies_are_one_point(spark):
    text = prose(np.random.default_rng(9), 200)
    df = spark.range(5000).selectExpr("id AS doc_id", f"'{text}' AS text")
    found = op5.near_copies(df).collect()
    assert len(found) == 4999 and {r.duplicate_of for r in found} == {0}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 900), (5, 5)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in op5.groups_of(edges).collect()} == {(i, 0) for i in range(1, 301)} | {(901, 900)}


def test_exact_dedup(spark):
    rows = [(3, "a", "x", 1), (1, "a", "y", 2), (1, "a", "x", 3), (None, "a", "x", 0), (7, None, "x", 1), (8, None, None, 1), (None, None, "x", None), (5, "", "x", 1), (4, "", None, 1), (None, "b", "x", 2), (None, "b", None, 1), (9, "A", "x", 1), (10, "a ", "x", 1), (11, "long" * 100_000, "x", 1), (12, "long" * 100_000, "x", 1)]
    df = spark.createDataFrame(rows * 2, "doc_id bigint, text string, t string, w int").repartition(5)
    kept = sorted(map(tuple, op9.exact_dedup(df).collect()), key=str)
    best = {}
    for r in rows:
        if r[1] is not None:
            key = (r[0] is None, r[0] or 0, r[2] is not None, r[2] or "", r[3])
            if r[1] not in best or key < best[r[1]][0]:
                best[r[1]] = (key, r)
    assert kept == sorted([r for _, r in best.values()] + [r for r in rows if r[1] is None] * 2, key=str)
    alone = sorted((r.doc_id, r.digest) for r in op9.kept_documents(df.where("doc_id < 7 AND text IS NOT NULL")).collect())
    assert [i for i, _ in alone] == [1, 4]


def test_exact_dedup_carries_columns_without_an_order(spark):
    rows = [(1, "a", {"x": 1}, 2), (1, "a", {"x": 0}, 2), (2, "a", None, 1), (3, None, {"y": 1}, 1), (3, None, {"y": 1}, 1), (None, "b", {}, None)]
    df = spark.createDataFrame(rows, "`doc.id` bigint, text string, m map<string,int>, s int").repartition(4)
    wide = df.selectExpr("*", "struct(m, s) AS n", "array(m) AS l")
    kept = op9.exact_dedup(wide, id_col="doc.id")
    assert kept.schema.simpleString() == wide.schema.simpleString()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    assert op9.exact_dedup(wide.limit(0), id_col="doc.id").count() == 0


def test_texts_with_one_digest_both_stay(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op9.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in op9.exact_dedup(df).collect()) == [1, 2]
