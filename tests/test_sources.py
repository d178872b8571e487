"""Files of several roles, data sets of one or two sparse files, places of tokens over parts of files."""

import pytest

from rankprep import sources as S
from rankprep.operators.ids import with_group_places


def test_a_file_has_one_role(spark, tmp_path):
    for name, head in (("latest_train.txt", "a"), ("train_valid_test.txt", "b"), ("valid_test", "c"), ("my.test", "d"), ("_test_hidden", "e"), ("other", "f")):
        (tmp_path / name).write_text(f"{head}\tr\tx\n{head}\ts\ty\n")
    got = sorted((r["split"], r["head"], r["relation"]) for r in S.read_triples(spark, str(tmp_path)).collect())
    assert got == [("test", "d", "r"), ("test", "d", "s"), ("train", "a", "r"), ("train", "a", "s"), ("train", "b", "r"), ("train", "b", "s"), ("valid", "c", "r"), ("valid", "c", "s")]
    assert [S.role_of(n) for n in ("latest", "xtestx", "validtest", "trainvalid")] == ["test", "test", "valid", "train"]


def test_a_folder_without_roles(spark, tmp_path):
    (tmp_path / "other").write_text("a\tb\tc\n")
    with pytest.raises(FileNotFoundError):
        S.read_triples(spark, str(tmp_path))


@pytest.mark.parametrize("few", [100_000, 0])
def test_places_of_tokens_over_parts_of_files(spark, tmp_path, monkeypatch, few):
    from rankprep.sources import readers

    monkeypatch.setattr(readers, "FEW_PARTS", few)
    files = {"train_1": " " + " ".join(f"w{i}" for i in range(3000)), "train_2": "xa b\n c ", "valid": "  one", "test": "x"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r["split"], r["pos"], r["token"]) for r in S.read_corpus(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(S.role_of(n), i, t) for n, text in files.items() for i, t in enumerate(text[1:].split(" "))]
    assert got == sorted(want)


def lines(head, rows):
    return "\n".join([head, *rows]) + "\n"


def test_sparse_data_sets(spark, tmp_path):
    one, two, bad = (tmp_path / n for n in ("one", "two", "bad"))
    for d in (one, two, bad):
        d.mkdir()
    (one / "whole.txt").write_text(lines("3 9 4", ["1,3 0:0.5 7:2", " 2:1", "", "0 8:1"]))
    rows, headers = S.read_sparse_dataset(spark, str(one))
    assert [(r["split"], r["row"], r["labels"], [tuple(f) for f in r["features"]]) for r in rows.orderBy("row").collect()] == [(None, 0, [1, 3], [(0, 0.5), (7, 2.0)]), (None, 1, [], [(2, 1.0)]), (None, 2, [0], [(8, 1.0)])]
    assert tuple(headers["all"]) == (3, 9, 4)
    (two / "train.txt").write_text(lines("2 9 4", ["1 0:1", "2 1:1"]))
    (two / "test.txt").write_text(lines("1 9 4", ["3 5:1"]))
    (two / "notes.md").write_text("nothing to read")
    rows, headers = S.read_sparse_dataset(spark, str(two))
    assert sorted((r["split"], r["row"], r["labels"]) for r in rows.collect()) == [("test", 0, [3]), ("train", 0, [1]), ("train", 1, [2])]
    assert set(headers) == {"train", "test"}
    (bad / "train.txt").write_text(lines("1 9 4", ["1 0:1"]))
    (bad / "test.txt").write_text(lines("1 8 4", ["3 5:1"]))
    with pytest.raises(ValueError, match="n_features: 9 in the train file, 8 in the test file"):
        S.read_sparse_dataset(spark, str(bad))
    (bad / "test.txt").write_text(lines("1 9 4", ["3 9:1"]))
    with pytest.raises(ValueError, match="10 features, but 9"):
        S.read_sparse_dataset(spark, str(bad))


def test_rows_of_a_large_sparse_file_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text(lines("2000 3000 9", [f"{i % 9} {i}:1" for i in range(2000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, _ = S.read_sparse_multilabel(spark, str(tmp_path / "a.txt"))
        assert [(r["row"], r["features"][0]["idx"]) for r in rows.orderBy("row").collect()] == [(i, i) for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_places_within_a_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), (None, 0)], "k string, v long")
    got = sorted(((r["k"], r["v"], r["_place"], r["_size"]) for r in with_group_places(df, ["k"], ["v"]).collect()), key=repr)
    assert got == sorted([(None, 0, 0, 3), (None, 1, 1, 3), (None, 2, 2, 3), ("a", 3, 0, 1)], key=repr)
