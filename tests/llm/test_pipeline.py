"""Each stage of the pipeline against a plain version, odd rows for every operator, and the registry."""

import os
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import op1_token_counts, op2_secret_scan, op4_mixing, op5_simhash, op7_sentencepiece, op8_quality_rules, op9_exact_dedup, queries
from loomgraph.llm.common import shared_dir
from tests.compare import assert_same

from .brute import encode, mixing, near_copies, prose, repeats

SF = "/root/testdata/sf0.001"


def documents() -> list[tuple]:
    rng = np.random.default_rng(13)
    out = []
    for i in range(0, 160, 4):
        text = prose(rng, int(rng.integers(60, 160)))
        source = ["web", "book", None][i // 4 % 3]
        out.append((i, text, "en", source, len(text)))
        if i % 16 == 0:
            out += [(i + 1, text, "en", "book", len(text)), (i + 2, text.replace(" ", "  ", 1), None, source, None)]
        if i % 20 == 0:
            out.append((i + 3, text + " " + text, "en", source, 1))
    return out + [(900, None, None, None, None), (901, "", "en", "web", 0), (None, "no id here", "en", "web", 3), (902, "日本語🦊", "ja", "web", 4), out[0]]


def test_stages_equal_brute_force(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [d for d in docs if (m := repeats(d[1], op8_quality_rules.MIN_WORDS))[0] <= op8_quality_rules.MAX_COVERED and m[1] <= op8_quality_rules.MAX_LONGEST]
    assert 0 < len(kept) < len(docs)
    order = lambda d: (d[0] is None, d[0] or 0, *[(x is not None, x) for x in (d[2:])])
    best: dict = {}
    for d in kept:
        if d[1] is not None and (d[1] not in best or order(d) < order(best[d[1]])):
            best[d[1]] = d
    unlike = [*best.values(), *[d for d in kept if d[1] is None]]
    gone = near_copies([d[:2] for d in unlike])
    apart = [d for d in unlike if d[0] not in gone]
    assert len(apart) < len(unlike) < len(kept)
    mixed = [d for d, (_, _, n) in zip(apart, mixing([(d[0], d[1], d[3]) for d in apart], op4_mixing.FLATTEN)) for _ in range(n)]
    assert len(mixed) > len(apart)
    want = Counter((d[0], None if d[1] is None else tuple(encode(d[1])), None if d[1] is None else True) for d in mixed)
    before = left(spark)
    got = Counter((r.doc_id, None if r.ids is None else tuple(r.ids), r.lossless) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert [x.rsplit("-", 1)[1] for x in left(spark) - before] == ["mixing"]  # just what the lazy result reads
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], (kept, unlike, apart, mixed)):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        assert Counter(map(tuple, out.collect())) == Counter(rows), name
        now = spark.createDataFrame(out.collect(), out.schema)


def left(spark) -> set:
    """Tables in the shared folder."""
    return {x for x in os.listdir(shared_dir(spark)) if x.startswith(("loomgraph-", "scratch-", "pipeline-"))}


def odd(spark):
    rows = [(i, t, None if i == 3 else "en", s, None) for i, t in [(1, "a b c"), (2, ""), (3, None), (None, "no id"), (None, None), (4, "x" * 200_000), (5, "w " * 60_000), (1, "a b c")] for s in ("web", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit(7).alias(c) for c in ("id", "h", "s", "t", "w", "x", "y", "node", "root", "row", "n", "rate", "copies", "tokens", "cells", "keep", "ids", "__gone", "__copies", "c0", "shard_", "a.b")])


@pytest.mark.parametrize(
    "make",
    [op1_token_counts.token_counts, op2_secret_scan.scan, op4_mixing.copies, op4_mixing.mix, op5_simhash.near_copies, op5_simhash.drop_near_copies, op7_sentencepiece.encode, op8_quality_rules.judge, op8_quality_rules.keep_documents, op9_exact_dedup.exact_dedup, op9_exact_dedup.kept_documents],
    ids=lambda f: f.__name__,
)
def test_odd_rows_and_empty_tables(spark, make):
    df = odd(spark)
    rows, whole = make(df).collect(), df.count()
    if make.__name__ in ("token_counts", "copies", "encode", "judge"):
        assert len(rows) == whole  # a result for each row, repeated or not
    assert make(df.limit(0)).collect() == []
    assert make(df.where("text IS NULL")).columns == make(df).columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    if not Path(SF).is_dir():
        pytest.skip("no test data")
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_registry():
    import __spark_entry__ as e

    names = {x.split("_")[0] for x in e.queries() if x.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 11)} and "pipeline" in e.queries()
    assert all(isinstance(x, str) for x in e.oracle_sql().values()) and set(e.oracle_sql()) <= set(e.queries())
