"""Line dedup, divergence audit and spelling variants against plain versions, on tables with all that tables can hold."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankprep.llm import divergence, line_dedup, spelling  # noqa: E402
from rankprep.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def texts(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "ZÉTA", "colour", "color", "colours", "honnour", "neighbour", "neighbor", "neighbours", "x" * 9, "x" * 10, "日本語", "don't", "a1b2"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "  ", "\r"]) for x in rng.choices(lines, k=rng.randrange(0, 9))]
        rows.append((i, "\n".join(own), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None])))
    rows += [(60, None, "en", "a"), (61, "", None, None), (62, "\n\n", "fr", "z"), (63, "only here " * 30_000, "en", "long"), (64, "neighbour " * 500 + "neighbou r", "en", "a"), (65, "\n".join(["The same line, over and over"] * 4000), "en", "b")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# ---- lines -----------------------------------------------------------------------------------------------------------


def plain_lines(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    who = lambda d, t: (d is not None, d if d is not None else t or "")
    held = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(who(d, t))
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        gone = [len(held[key(x)]) >= docs and d != (lambda m: m[1] if m[0] else None)(max(held[key(x)])) if len(key(x)) >= least else False for x in own]
        kept = "\n".join(x for x, g in zip(own, gone, strict=True) if not g)
        out.append((d, len(own), sum(gone), kept))
    return out


def dropped(df, **options):
    out = line_dedup.drop_repeated_lines(df, **options)
    return out, sorted(((r["doc_id"], r["line_count"], r["line_dropped"], r["line_text"]) for r in out.collect()), key=repr)


def test_lines(docs, rows):
    _, got = dropped(docs)
    assert got == sorted(plain_lines(rows), key=repr)
    assert sum(r[2] for r in got) > 50
    _, got = dropped(docs, min_length=3, min_docs=2)
    assert got == sorted(plain_lines(rows, 3, 2), key=repr)


def test_lines_of_repeated_and_missing_ids(spark):
    a, b = "a line that several documents hold", "another one that several hold"
    rows = [(1, a), (1, a + "\nonly here"), (2, a), (3, b), (3, b), (3, b), (None, a), (None, b), (None, b + "\nmore"), (None, b + "\nmore"), (4, a + "\n" + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, got = dropped(df)
    assert got == sorted(plain_lines(rows), key=repr)
    only_missing = spark.createDataFrame([(None, a + f"\n{i}") for i in range(4)], "doc_id long, text string")
    assert all(r[2] == 0 for r in dropped(only_missing)[1])  # the keeper has no id, so all keep it


def test_lines_of_odd_tables(spark, docs, rows):
    assert dropped(docs.limit(0))[1] == []
    own = docs.select("doc_id", "text", "lang", *[docs["source"].alias(c) for c in ("line_text", "_line_gone", "_line_own", "_line_same", "_line_text", "line_count")])
    out, got = dropped(own)
    assert got == sorted(plain_lines(rows), key=repr)
    assert set(out.columns) == {*own.columns, "line_dropped"}
    assert out.where("_line_gone IS NOT NULL").count() == sum(r[3] is not None for r in rows)
    assert {r["key_md5"] for r in line_dedup.repeated_lines(docs).collect()}


def oracle(name, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=repr)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_source_divergence"])
def test_queries_equal_their_sql(spark, rows, folder, name):
    df = QUERIES[name](spark, folder)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == oracle(name, rows)


def test_line_query_gives_the_hash_of_what_stays(spark, rows, folder):
    got = sorted(map(tuple, QUERIES["op11_line_dedup"](spark, folder).collect()))
    assert got == sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in plain_lines(rows))


# ---- terms -----------------------------------------------------------------------------------------------------------


def plain_divergences(rows, min_docs=3, top=200):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = Counter(x.translate(LOW) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        counts[lang, source].update(own)
        found[lang].update(own.keys())
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted((t for t, n in found[lang].items() if n >= min_docs), key=lambda t: t.encode())
        sources = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        shares, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(o, sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (shares[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,terms,held", [(32, 8192, 400_000), (2, 3, 5), (1, 100, 50)])
def test_divergences(docs, rows, monkeypatch, block, terms, held):
    monkeypatch.setattr(divergence, "HELD", held)
    got = divergence.source_divergences(docs, block=block, terms=terms, top=4)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_divergences(rows, top=4)


def test_divergences_of_odd_tables(spark, docs, rows):
    assert divergence.source_divergences(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, "one two", "en", "a")], SCHEMA)
    assert divergence.source_divergences(alone).count() == 0
    # two groups without a kept term: the pairs are told, with 0
    two = spark.createDataFrame([(1, "one", "en", "a"), (1, None, "en", "b"), (None, "", None, "c")], SCHEMA)
    assert sorted(map(tuple, divergence.source_divergences(two).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    more = docs.selectExpr("*", "'x' AS term", "1 AS g", "2 AS n", "'y' AS item", "3 AS docs").union(docs.selectExpr("*", "'x'", "1", "2", "'y'", "3"))
    assert sorted(map(tuple, divergence.source_divergences(more).collect()), key=repr) == plain_divergences(rows + rows)


def test_scaled_shares_are_exact(spark):
    rng = random.Random(1)
    rows = [(n, n + rng.randrange(10**k)) for k in range(1, 16) for n in [rng.randrange(1, 10**k) for _ in range(20)]]
    df = spark.createDataFrame(rows, "n long, total long")
    got = df.select("n", "total", divergence.scaled(df["n"], df["total"]).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["n"] // r["total"] for r in got)


# ---- spelling --------------------------------------------------------------------------------------------------------


def plain_words(rows, every=31, least=7):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, factor=10):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= factor * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def told(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_spelling_query(spark, rows, folder):
    got = told(QUERIES["op13_spelling_variants"](spark, folder))
    assert got == plain_groups(plain_words(rows))
    assert any(r[1] for r in got)


@pytest.mark.parametrize("partitions", [1, 6])
def test_spelling_groups(spark, partitions):
    """Runs of equal letters, letters beyond the basic plane, prefixes across parts, chains of forms, and ties."""
    rng = random.Random(partitions)
    n = {}
    for base in ["aaaaaaa", "abababab", "abcdefgh", "zzzzzzzy", "ééééé\U0001f600", "prefixes", "prefixed"]:
        n[base] = rng.choice([3, 5000])
        for _ in range(60):
            w = list(rng.choice(list(n)))
            k, i, c = rng.randrange(3), rng.randrange(len(w)), rng.choice("abcdefé\U0001f600z")
            if k == 0:
                w[i] = c
            elif k == 1:
                w.insert(i, c)
            else:
                del w[i]
            n.setdefault("".join(w), rng.choice([2, 2, 2, 20, 20, 200, 200, 4000]))
    n["solitary" * 300] = 2
    n["solitary" * 300 + "x"] = 20
    n.pop("", None)
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = told(spelling.spelling_groups(words))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_groups(n)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of two forms


def test_spelling_of_odd_tables(spark, docs, rows):
    assert told(spelling.spelling_groups(spark.createDataFrame([], "word string, n long"))) == []
    odd = spark.createDataFrame([(None, 5, "x"), ("alone", 2, None)], "word string, n long, form string")
    assert told(spelling.spelling_groups(odd)) == [("alone", None, "alone", 2, 0, None)]
    more = docs.union(docs).selectExpr("*", "'a' AS word", "1 AS n", "2 AS id")
    counted = {r["word"]: r["n"] for r in spelling.word_counts(more, drop_every=31).collect()}
    assert counted == plain_words(rows + rows)
    missing = spark.createDataFrame([(None, "Wonderful wonderful"), (None, None)], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(missing, drop_every=1).collect()} == plain_words([(None, "Wonderful wonderful")], 1)
    with pytest.raises(ValueError, match="more frequent"):
        spelling.spelling_groups(odd, factor=1)
