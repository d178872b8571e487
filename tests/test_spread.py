"""Users of very many rows, exact cuts without sorts, k-core by frontiers: equal to the plain ways at any size."""

import random

import pytest
from pyspark.sql import functions as F

from rankprep.operators import ids, interact, sequence, split


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    users = ["hot"] * 120 + [None] * 30 + [f"u{i}" for i in range(12) for _ in range(rng.randrange(1, 12))]
    rng.shuffle(users)
    data = [(u, rng.randrange(9), float(rng.randrange(40)), i, float(i)) for i, u in enumerate(users)]
    return spark.createDataFrame(data, "user_id string, item_id long, ts double, tie long, rating double").repartition(7)


def told(df):
    return sorted((str({c: r[c] for c in sorted(df.columns)}) for r in df.collect()))


@pytest.mark.parametrize("parts", [2, 9])
def test_hot_users_are_spread_without_a_difference(spark, rows, monkeypatch, parts):
    order = ["ts", "tie"]

    def results():
        yield split.split_by_ratio(rows, ["tie"])
        yield split.shuffle_within_user(rows, ["tie"])
        yield split.leave_n_out(rows, order, 3)
        yield sequence.sequence_examples(rows, order, 4, ["item_id", "rating"])
        yield sequence.sequence_examples(split.leave_n_out(rows, order), order, 50)
        yield sequence.sequence_examples(rows, order)
        yield sequence.train_items(split.leave_n_out(rows, order), order)

    plain = [told(df) for df in results()]
    assert ids.hot_groups(rows, "user_id").count() == 0
    monkeypatch.setattr(ids, "HOT", 10)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {"hot", None} <= {r["user_id"] for r in ids.hot_groups(rows, "user_id").collect()}
        spread = [told(df) for df in results()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for a, b in zip(plain, spread, strict=True):
        assert a == b


@pytest.mark.parametrize("n,few,step", [(0, 3, 16), (1, 3, 16), (700, 1, 3), (700, 40, 16)])
def test_cuts_hold_for_just_so_many_rows(spark, monkeypatch, n, few, step):
    """Also where many draws are equal and only the keys, one of them null, tell rows apart."""
    monkeypatch.setattr(ids, "FEW_VALUES", few)
    monkeypatch.setattr(ids, "_STEP", step)
    df = spark.range(n).select((F.col("id") % 7).alias("a"), F.when(F.col("id") > 0, F.col("id")).alias("id"))
    for u in (F.col("a") / 8.0, F.coalesce(F.col("id"), F.lit(0)) / 1024.0, F.lit(0.5)):
        size, conditions = ids.cuts(df, u, ["a", "id"], lambda m: [0, 1, m // 3, m // 2, max(0, m - 1), m, m + 5])
        assert size == n
        order = [r["id"] or 0 for r in df.orderBy(u, "a", F.col("id").asc_nulls_first()).collect()]
        for rank, condition in zip([0, 1, n // 3, n // 2, max(0, n - 1), n, n + 5], conditions, strict=True):
            got = {r["id"] or 0 for r in df.where(condition).collect()}
            assert got == set(order[:rank])


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_kcore_against_a_plain_one(spark, monkeypatch, few):
    monkeypatch.setattr(interact, "FEW", few)
    rng = random.Random(6)
    pairs = [(int(rng.paretovariate(0.6)) % 60, str(int(rng.paretovariate(0.5)) % 50)) for _ in range(500)] + [(None, "1")] * 4 + [(3, None)] * 2
    df = spark.createDataFrame(pairs, "user_id long, item_id string").withColumn("k", F.monotonically_increasing_id())
    for a, b in ((3, 5), (1, 4), (6, 1), (1, 1), (400, 2)):
        left = list(pairs)
        while True:
            from collections import Counter

            u, i = Counter(x for x, _ in left), Counter(y for _, y in left)
            rest = [(x, y) for x, y in left if u[x] >= a and i[y] >= b]
            if len(rest) == len(left):
                break
            left = rest
        got = interact.kcore(df, a, b)
        assert got.columns == df.columns
        assert sorted(((r["user_id"], r["item_id"]) for r in got.collect()), key=repr) == sorted(left, key=repr)


def test_heavy_tokens_are_encoded_like_others(spark, monkeypatch):
    monkeypatch.setattr(ids, "HOT", 50)
    monkeypatch.setattr(ids, "HEAVY", 1 / 20)
    rng = random.Random(3)
    tokens = ["the"] * 300 + ["of"] * 60 + [f"t{rng.randrange(200)}" for _ in range(200)] + [None, "unknown", ""]
    rng.shuffle(tokens)
    df = spark.createDataFrame(list(enumerate(tokens)), "pos long, token string").repartition(5)
    vocab = ids.frequency_vocab(df.where("token <> 'unknown' AND token IS NOT NULL"), ["pos"])
    number = {r["token"]: r["id"] for r in vocab.collect()}
    for v in (vocab, vocab.drop("freq")):
        got = {r["pos"]: r["token"] for r in ids.encode_tokens(df, v, ["token"]).collect()}
        assert got == {i: number.get(t, 0) for i, t in enumerate(tokens)}
    rows = spark.createDataFrame([(i, tokens[i : i + 9]) for i in range(0, 500, 9)] + [(1000, []), (1001, None)], "k long, words array<string>")
    got = {r["k"]: r["words"] for r in ids.encode_tokens(rows, vocab, ["words"], ["k"]).collect()}
    assert got[1000] == got[1001] == [] and all(got[i] == [number.get(t, 0) for t in tokens[i : i + 9]] for i in range(0, 500, 9))


def test_scratch_deletes_what_was_saved_within(spark):
    import os

    from rankprep.tables import saved, scratch

    with scratch():
        outer = saved(spark.range(3))
        with scratch():
            inner = saved(outer.where("id > 0"))
            assert inner.count() == 2
        assert not os.path.exists(inner._saved_at) and outer.count() == 3
    assert not os.path.exists(outer._saved_at)
    assert os.path.exists(saved(spark.range(1))._saved_at)
