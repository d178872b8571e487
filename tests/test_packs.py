"""Pruned search over packs of blocks, one or several; seen items told by groups; what is written on the way."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import vectors

from rankprep import tables
from rankprep.operators import pruned, retrieval


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    groups = rng.normal(size=(9, 5)) * 3
    x = np.round(np.concatenate([g + rng.normal(size=(25, 5)) * 0.3 for g in groups] + [np.zeros((1, 5)), groups[:2], groups[:2]]), 2)
    q = np.concatenate([np.round(groups + rng.normal(size=groups.shape), 2), np.zeros((1, 5)), x[:20]])
    items = vectors(spark, x)
    queries = vectors(spark, q, 0, "query_id").withColumn("group", F.when(F.col("query_id") % 5 > 0, F.col("query_id") % 5)).withColumn("target", F.col("query_id") * 7 + 1)
    members = items.select((F.col("item_id") % 4 + 1).alias("group"), "item_id").where("item_id % 3 > 0")
    members = members.unionByName(members.limit(9)).unionByName(spark.createDataFrame([(None, 1), (9, 2), (1, 999)], "group long, item_id long"))
    seen = spark.createDataFrame([(int(a), int(b)) for a in range(25) for b in rng.integers(1, 235, 6)], "query_id long, item_id long")
    pairs = queries.join(members, "group").select("query_id", "item_id").unionByName(seen)
    codes = items.select("item_id", F.floor((F.col("item_id") - 1) / 25).cast("int").alias("k0"), F.lit(0).alias("k1"))
    return items, queries, members, seen, pairs, codes


def told(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("scorer", ["inner", "cosine", "euclidean"])
def test_seen_by_groups_is_seen_by_pairs(data, monkeypatch, scorer):
    items, queries, members, seen, pairs, _ = data
    want = told(retrieval.top_k_unseen(queries, items, pairs, 6, scorer))
    assert told(retrieval.top_k_unseen(queries, items, seen, 6, scorer, members)) == want
    if scorer != "cosine":  # a zero vector has none
        left = retrieval.score_unseen(queries, items, pairs, scorer)
        assert told(retrieval.score_unseen(queries, items, seen, scorer, members)) == told(left)
        assert told(retrieval.unseen_totals(queries, items, seen, scorer, members)) == told(left.groupBy("query_id").agg(F.count("*"), F.max("score")))
    monkeypatch.setattr(retrieval, "BROADCAST", 50)  # members become rows
    assert told(retrieval.top_k_unseen(queries, items, seen, 6, scorer, members)) == want


@pytest.mark.parametrize("scorer", ["inner", "cosine", "euclidean"])
def test_several_packs(data, monkeypatch, scorer):
    """Items in four packs of blocks give what all scores give, and queries skip blocks."""
    items, queries, members, seen, pairs, codes = data
    top, hidden = told(retrieval.top_k(queries, items, 6, scorer)), told(retrieval.top_k_unseen(queries, items, pairs, 6, scorer))
    ranks = [told(retrieval.target_rank(queries, items, scorer, pad)) for pad in (False, True)]
    monkeypatch.setattr(retrieval, "BROADCAST", 300)
    monkeypatch.setattr(pruned, "STEP", 7)
    monkeypatch.setattr(pruned, "ITEMS", 11)
    monkeypatch.setattr(pruned, "ROWS", 16)
    blocks = pruned.build_blocks(items, scorer, codes, block=5)
    assert pruned._packs(blocks)[-1] >= 3
    found, trips = pruned.top_k(queries, blocks, 6)
    assert told(found) == top
    visits = trips.agg(F.sum("n_visited"), F.sum("n_blocks"), F.count("*")).first()
    assert visits[0] < 0.6 * visits[1] and visits[2] == queries.count() - (scorer == "cosine")
    assert told(pruned.top_k(queries, blocks, 6, pairs)[0]) == hidden
    monkeypatch.setattr(retrieval, "BROADCAST", 400)
    assert told(pruned.top_k(queries, blocks, 6, seen, members)[0]) == hidden
    assert [told(pruned.target_rank(queries, blocks, items, pad)[0]) for pad in (False, True)] == ranks


def written(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tables.shared_dir(spark).removeprefix("file:")) for f in names)


@pytest.mark.parametrize("what", ["top_k", "top_k_unseen", "target_rank"])
def test_queries_are_not_written_for_each_block(spark, what):
    """400 queries that visit most of 400 blocks."""
    x = np.random.default_rng(2).normal(size=(1600, 16))
    items, queries = vectors(spark, x), vectors(spark, x[:400], 1, "query_id").withColumn("target", F.col("query_id"))
    blocks = pruned.build_blocks(items, "inner", items.select("item_id", F.lit(0).alias("k0"), F.lit(0).alias("k1")), block=4)
    before = written(spark)
    own = queries.select("query_id", F.col("query_id").alias("item_id"))
    out, trips = {"top_k": lambda: pruned.top_k(queries, blocks, 10), "top_k_unseen": lambda: pruned.top_k(queries, blocks, 10, own), "target_rank": lambda: pruned.target_rank(queries, blocks, items)}[what]()
    assert out.count() >= 400 and trips.agg(F.avg("n_visited")).first()[0] > 40
    assert written(spark) - before < 400_000


def test_link_prediction_meets_vectors_once(spark, monkeypatch):
    """Ids are told apart before any vector is met."""
    from conftest import SMALL
    from rankprep.plans import graphs

    seen = []
    look = graphs.G.lookup_vectors
    monkeypatch.setattr(graphs.G, "lookup_vectors", lambda df, v, *a: seen.append(df) or look(df, v, *a))
    graphs.kg_link_prediction(spark, SMALL)
    ids = ["head_id", "relation_id", "tail_id"]
    assert seen[0].columns == ids and seen[0].count() == seen[0].distinct().count()
