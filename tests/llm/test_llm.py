"""Text operators against plain versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from rankprep.llm import common, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, mixing, personal_data, quality, substring_dedup, suffix_dedup  # noqa: E402
from rankprep.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join("w%d" % min(int(rng.paretovariate(0.7)), words) for _ in range(n))


def documents(seed=1, n=40):
    """Random texts with exact copies, near copies, shared passages, and what else tables hold."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 150)) for _ in range(n)]
    passage = prose(rng, 70)
    rows = []
    for i, t in enumerate(base):
        rows.append(t)
        if i % 5 == 0:
            rows.append(t)  # an exact copy
        if i % 4 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            rows.append(" ".join(w))
        if i % 7 == 0:
            w = t.split()
            k = rng.randrange(len(w) + 1)
            rows.append(" ".join(w[:k] + passage.split() + w[k:]))
    rows += ["", None, " \t\n", "One", "one two", "ONE two", "éè 中文 \U0001f600", prose(rng, 30_000), "same " * 3000]
    rng.shuffle(rows)
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, None) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return common.saved(spark.createDataFrame(documents(), SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])


def empty(docs):
    return docs.where("doc_id < -5")


def odd(spark):
    """Null ids, repeated rows, and columns whose names the operators use inside."""
    data = [(1, "a b c d e f g h", "en", "x", 15), (1, "a b c d e f g h", "en", "x", 15), (None, "a b c d e f g h", None, None, None), (2, None, "de", None, 0), (3, "", None, "y", 0)]
    return spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(7) for c in ("size", "h", "u", "pos", "token", "component", "target", "packed", "score")})


# ---- shared pieces ---------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({x for e in links for x in e}, links)
    assert all(got.get(k, k) == v for k, v in want.items()) and set(got) <= set(want)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_those_of_the_pattern():
    texts = ["Hello  wörld\tfoo", " a b ", "", None, "x", "a b \x1f c\x0b\x0cd"]
    import pyarrow as pa

    data, offsets = common.text_bytes(pa.array(texts))
    starts, ends, at, hashes = common.words(data, offsets)
    got = [[bytes(data[a:b]) for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    assert len(set(hashes.tolist())) == len({w for g in got for w in g})


# ---- 1: decontamination ----------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randrange(8, 60), 5000)) for i in range(25)] + [(90, None), (91, ""), (92, "too short"), (93, None)]
    rows, planted = [], set()
    for d in range(150):
        w = prose(rng, rng.randrange(1, 200), 5000).split()
        if d % 3 == 0:
            item, text = items[rng.randrange(25)]
            own = text.upper().split() if d % 2 else text.split()
            for _ in range(int(0.15 * len(own))):
                k = rng.randrange(len(own))
                own[k] = f"new{k}"
            w = w + own if d % 4 else own + w
            planted.add((d, item))
        rows.append((d, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "  "), (None, items[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(planted - got) <= 1 and (None, 3) in got
    assert got - planted - {(None, 3)} == set()  # clean documents stay
    assert all(r["edits"] <= 0.2 * r["item_words"] for r in found)
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(df, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(df, bench.where("item_id < 0")).count() == 0
    assert decontaminate.contaminated(df.where("doc_id < 0"), bench).count() == 0
    assert decontaminate.without_contaminated(odd(spark), bench).count() == 5


def test_decontamination_against_all_pairs(spark):
    """Every item against every text by edit distance alone; items of few words wherever they stand, or as whole texts."""
    rng = random.Random(14)
    items = [(i, prose(rng, rng.randrange(5, 30), 300)) for i in range(15)] + [(50, "Yes no."), (51, "yes NO"), (None, "w3"), (52, "w4 w2 w1")]
    rows = []
    for d in range(80):
        w = prose(rng, rng.randrange(1, 120), 300).split()
        if d % 2:
            own = items[rng.randrange(15)][1].split()
            for _ in range(rng.randrange(0, max(1, len(own) // 4))):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = [rng.choice(w)]
            k = rng.randrange(len(w) + 1)
            w[k:k] = own
        rows.append((d, " ".join(w)))
    rows += [(200, "yes, no!"), (201, "well yes no"), (202, prose(rng, 20_000, 300) + " " + items[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edits", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(df, bench).collect()}
    want, alone = {}, set()
    tokens = lambda t: decontaminate._tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0][:-1]
    for d, t in rows:
        for i, text in items:
            own = tokens(text)
            if len(own) < 5:
                all_words = tokens(t)
                if any(np.array_equal(own, all_words[a : a + len(own)]) for a in range(len(all_words))):
                    want[d, i] = 0
                if np.array_equal(own, all_words):
                    alone.add((d, i))
                continue
            cost = decontaminate.best_match(own, tokens(t))[0]
            if cost <= decontaminate.allowed_edits(len(own), 0.2):
                want[d, i] = cost
    assert {(200, 50), (200, 51)} <= set(want) and len(want) > 30
    assert set(found) <= set(want) and all(found[k] == want[k] for k in found)
    assert len(found) >= 0.97 * len(want) and {(200, 50), (200, 51), (202, 4)} <= set(found)
    short = {50, 51, 52, None}
    assert {k for k in found if k[1] in short} == {k for k in want if k[1] in short} and (201, 50) in found
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, short_inside=False).collect()}
    assert {k for k in whole if k[1] in short} == {k for k in alone if k[1] in short}
    assert {k for k in whole if k[1] not in short} == {k for k in found if k[1] not in short}


def test_short_items(spark):
    items = [(1, "zebra quantum pickle"), (2, "Zebra"), (None, "quantum pickle bar baz of"), (None, "bar")]
    texts = [(1, "foo zebra quantum pickle bar baz, zebra"), (2, "quantum"), (3, "zebra quantum"), (4, "pickle of zebra\nquantum pickle")]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"] or -1, r["item_words"], r["first_word"], r["end_word"]) for r in decontaminate.contaminated(df, bench).collect()))
    assert got == [(1, -1, 1, 4, 5), (1, -1, 5, 2, 6), (1, 1, 3, 1, 4), (1, 2, 1, 1, 2), (3, 2, 1, 0, 1), (4, 1, 3, 2, 5), (4, 2, 1, 2, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(df, bench).collect()) == [2, 3, 4]


def test_best_match_is_the_edit_distance():
    rng = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(60):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 14))]
        cost, a, b = decontaminate.best_match(np.array(item, np.uint64), np.array(text, np.uint64))
        want = min(distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert cost == want == distance(item, text[a:b])


# ---- 2 and 6: repeated substrings ------------------------------------------------------------------------------------


@pytest.mark.parametrize("length,bucket_rows", [(60, 50_000), (60, 2), (7, 50_000)])
def test_byte_dedup(spark, docs, rows, length, bucket_rows):
    some = docs.where(F.length("text") < 3000) if length == 7 else docs
    kept = [r for r in rows if r[1] is not None and len(r[1]) < 3000] if length == 7 else rows
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(some, length, False, bucket_rows).collect()), key=lambda r: r[0])
    assert got == brute.byte_dedup(kept, length)


def test_planted_passages_of_400_bytes(spark, tmp_path):
    """All holders lose a passage that repeats, the first one too; passages of over 50 words but under 400 bytes stay."""
    rng = random.Random(5)
    texts = [prose(rng, 200, 10**6) for _ in range(30)]
    long, short = prose(rng, 120, 10**6), prose(rng, 55, 10**6)
    assert len(short) < 390 and len(long) >= 400
    for i in (3, 11, 20):
        texts[i] = f"{texts[i][:300]} {long} {texts[i][300:]}"
    for i in (6, 20, 25):
        texts[i] = f"{texts[i]} {short}"
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, str(tmp_path)).collect())
    assert got == brute.byte_dedup(rows, 400)
    assert {r[0] for r in got if r[2]} == {3, 11, 20}
    assert all(len(long) <= r[2] <= len(long) + 10 and r[3] == 1 for r in got if r[2])


def test_byte_dedup_odd_tables(spark, docs):
    got = suffix_dedup.remove_repeats(odd(spark), 10).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in got) == [(0, 15, 1), (1, 15, 1), (1, 15, 1), (2, 0, 0), (3, 0, 0)]
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_intervals_visit_every_common_prefix():
    words = sorted(["banana", "bandana", "ban", "apple", "app", "bandit"])
    lcp = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(words, words[1:])]
    got = set(suffix_dedup.intervals(lcp, 0))
    assert got == {(3, 0, 1), (3, 2, 5), (4, 4, 5), (0, 0, 5)}


@pytest.mark.parametrize("window", [50, 5, 1])
def test_word_dedup(spark, docs, rows, window):
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs, window, False).collect()), key=lambda r: r[0])
    assert got == brute.substring_dedup(rows, window)


def test_word_dedup_odd_tables(spark, docs):
    got = substring_dedup.remove_repeats(odd(spark), 4).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 8, 0), (1, 8, 8), (1, 8, 8), (2, 0, 0), (3, 0, 0)]
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def test_rows_of_one_id_keep_what_only_they_hold(spark):
    """Spans found in one row never cut another row of the same id, or of none."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 90) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, b), (5, c), (5, c), (6, b[:200] + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    number = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())))}
    numbered = [(number[r], r[1]) for r in rows]
    byte = [(r[0], *x[1:]) for r, x in zip(rows, brute.byte_dedup(numbered, 60), strict=True)]
    word = [(r[0], *x[1:]) for r, x in zip(rows, brute.substring_dedup(numbered, 20), strict=True)]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df, 60, False).collect()), key=repr) == sorted(byte, key=repr)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df, 20, False).collect()), key=repr) == sorted(word, key=repr)
    alone = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(alone, 60).collect()} == {(1, len(a)), (2, len(a)), (2, 0)}


def test_covers_are_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# ---- 3: mixing -------------------------------------------------------------------------------------------------------


def filled(sizes, weights, share, cap):
    """Clamp and reshare until nothing is above."""
    total = share * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        give = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if give[i] > cap * sizes[i]}
        for i in open_:
            target[i] = cap * sizes[i] if i in over else give[i]
        if not over:
            break
        open_ -= over
    return target


def test_mixing_rounds_rows_without_or_with_one_id_each_by_itself(spark):
    """Rows that agree in all columns, too: each source's words come near its target."""
    rows = [(None, "three words here", s) for s in "xyz" for _ in range(3000)] + [(7, f"other text of {i}", "u") for i in range(2000)] + [(None, None, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix_sources(df).groupBy("source", "mix_target").agg(F.sum("mix_taken").alias("taken"), F.max(F.col("mix_taken") - 2 * F.col("mix_size")).alias("over")).collect()
    assert len(got) == 4
    for r in got:
        assert abs(r["taken"] - r["mix_target"]) < 0.03 * r["mix_target"] and r["over"] <= 0
    told = lambda d: sorted(map(str, mixing.mix_sources(d).select("doc_id", "text", "source", "mix_taken").collect()))
    assert told(df) == told(df.repartition(3))


@pytest.mark.parametrize("sizes", [[100, 1, 50, 7], [5, 5, 5], [0, 10, 90], [1000, 1, 1, 1, 1]])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = filled(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mixing(spark, docs, rows):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["mix_size"] == len(brute.words(r["text"])) and 0 <= r["mix_taken"] <= 2 * r["mix_size"]
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["mix_taken"] for r in own) - own[0]["mix_target"]) <= 3 * math.sqrt(len(own)) + 1
    again = {r["doc_id"]: r["mix_taken"] for r in mixing.mix_sources(docs.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["mix_taken"] for r in out}
    assert mixing.mix_sources(empty(docs)).count() == 0 and mixing.mix_sources(odd(spark)).count() == 5


# ---- 4: licenses -----------------------------------------------------------------------------------------------------


def test_licenses(spark, docs):
    texts = ["prose\nReleased under the MIT License.\nmore prose here", "All rights reserved.", "Licensed under the Apache License, Version 2.0.", "the license of birds is free", None, "", "word " * 20000 + "Licensed under CC BY-NC 4.0. " + "word " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["line"], r["missing"], r["extra"]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {0: ("MIT", 1, [], []), 1: ("proprietary", 0, [], []), 2: ("Apache-2.0", 0, [], []), 6: ("CC-BY-NC-4.0", 0, [], [])}
    near = spark.createDataFrame([(1, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions hold:")], "doc_id long, text string")
    r = license_scan.scan_licenses(near).first()
    assert (r["license"], r["missing"], r["extra"]) == ("BSD", ["are", "met"], ["any"]) or (r["license"] == "BSD" and "any" in r["extra"])
    assert license_scan.scan_licenses(empty(docs)).count() == 0 and license_scan.scan_licenses(odd(spark)).count() == 0


def test_licenses_are_all_found(spark):
    """Several notices in one block or one long line, notices that begin before their cue, and broken cues."""
    apache, mit, kept = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved."
    long = "".join(f"{license_scan.TEMPLATES[n][0]} " for n in ("GPL-2.0", "LGPL-3.0", "MPL-2.0", "CC-BY-NC-4.0", "BSD", "CC0-1.0"))
    cases = [
        (f"{apache}\n{mit}\n{kept}", [("Apache-2.0", 0), ("MIT", 1), ("proprietary", 2)]),
        (f"{mit} {kept} {mit}", [("MIT", 0), ("proprietary", 0), ("MIT", 0)]),
        ("word " * 600 + apache + " word" * 100 + " " + mit + " word" * 600, [("Apache-2.0", 0), ("MIT", 0)]),
        ("prose\nThis work is\nlicensed under the GNU General Public License, version 2.\nprose", [("GPL-2.0", 1)]),
        ("prose\n# Permission\n# to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", [("ISC", 1)]),
        (long, [(n, 0) for n in ("GPL-2.0", "LGPL-3.0", "MPL-2.0", "CC-BY-NC-4.0", "BSD", "CC0-1.0")]),
        ("the license of birds\n" * 50, []),
        ("This work is licensed under the GNU Affero General Public License, version 2.", []),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", [("LGPL-2.1", 0)]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", [("AGPL-3.0", 0)]),
        ("Licensed under CC BY-ND 4.0. Licensed under CC BY-NC-SA 4.0.", [("CC-BY-ND-4.0", 0), ("CC-BY-NC-SA-4.0", 0)]),
        (" ".join(t for own in license_scan.TEMPLATES.values() for t in own), [(n, 0) for n, own in license_scan.TEMPLATES.items() for _ in own]),
        ("x " * 200_000 + mit + " y" * 200_000, [("MIT", 0)]),
        ("Apache License 2.0", [("Apache-2.0", 0)]),
        ("// SPDX-License-Identifier: MIT", [("MIT", 0)]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", [("GPL-2.0", 0)]),
        ("Licensed under GPLv3.", [("GPL-3.0", 0)]),
        ("Under GPL v4, released under the GPL-4.0", []),
        ("ALL\nRIGHTS\nRESERVED", [("proprietary", 0)]),
        ("licensed under the MIT license - see LICENSE", [("MIT", 0)]),
        ("licensed under the GNU General Public License v2", [("GPL-2.0", 0)]),
        ("the MIT people have a license, and the BSD has none", []),
        ("MIT License\n\nCopyright (c) me\n\n" + license_scan.NOTICES["MIT"][2].replace(". ", ".\n\n"), [("MIT", 0), ("MIT", 4)]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {i: [] for i in range(len(cases))}
    for r in license_scan.scan_licenses(df).collect():
        assert (r["missing"], r["extra"]) == ([], []) and r["reduction"] > 0
        got[r["doc_id"]].append((r["license"], r["line"]))
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_licenses_against_all_alignments():
    """Ranked by bytes saved, the notices of a text are those that a scan of every stretch of its words confirms."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.9)
    rng, filler = np.random.default_rng(4), "la porte del norte und haus birds river not stone".split()
    for _ in range(60):
        picked = [scanner.wordings[i] for i in rng.integers(len(scanner.wordings), size=3)]
        text = " ".join(" ".join([*rng.choice(filler, rng.integers(8, 12)), wording]) for _, wording in picked)
        words = license_scan._plain(license_scan._WORD.findall(text.lower().encode()))
        stretches = [(len(want), i, p) for i, want in enumerate(scanner.words) for p in range(len(words)) if words[p : p + len(want)] == want]
        taken, plain = set(), []
        for size, i, p in sorted(stretches, key=lambda x: (-x[0], x[2])):
            if not taken & set(range(p, p + size)):
                taken |= set(range(p, p + size))
                plain.append((p, scanner.wordings[i][0]))
        assert [h["license"] for h in scanner.notices(text.encode())] == [name for _, name in sorted(plain)], text


def test_licenses_with_clashing_columns(spark):
    rows = [(1, "All rights reserved.", "a", 2), (1, "All rights reserved.", "a", 2), (None, "Apache License 2.0", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, line int")
    got = sorted((r["doc_id"] or 0, r["license"], r["line"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(0, "Apache-2.0", 0), (1, "proprietary", 0), (1, "proprietary", 0)]


# ---- 5: embeddings ---------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    big = rng.normal(size=16) + 0.02 * rng.normal(size=(60, 16))  # more links than a list holds
    x = np.concatenate([x, x[:40] + 0.03 * rng.normal(size=(40, 16)), big, x[:3], x[:1] * 5])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [None] + [1.0] * 15, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, [float("inf")] + [1.0] * 15, 1), (2005, [1.0, 2.0], 1), (None, x[0].tolist(), 1), (0, x[0].tolist(), 9), (2006, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1))
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    want = near.sum(1)
    links = sum(by[i]["n_links"] for i in range(len(x)))
    assert 0.9 * want.sum() <= links <= want.sum() and all(by[i]["n_links"] <= want[i] for i in range(len(x)))
    comp = brute.components(range(len(x)), np.argwhere(near).tolist())
    assert sum(by[i]["component_id"] != comp[i] for i in range(len(x))) <= 0.02 * len(x)
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"]
    assert by[None]["component_id"] is None and by[None]["n_links"] == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def tight_groups(rng, singles=200, each=12, dim=32):
    """Three times two groups at a cosine of 0.96 to each other, closer within than a list can show, and single vectors."""
    x = [rng.normal(size=(singles, dim))]
    for _ in range(3):
        a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        for middle in (a, 0.96 * a + math.sqrt(1 - 0.96**2) * b):
            x.append(middle + 0.0005 * rng.normal(size=(each, dim)))
    x = np.concatenate(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    return x, near


@pytest.mark.parametrize("recall", [0.98, 2.0])
def test_embeddings_link_across_tight_groups(spark, recall):
    """Also where the audit never passes (a recall above 1), so that all is compared."""
    x, near = tight_groups(np.random.default_rng(4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, recall=recall).collect()}
    comp = brute.components(range(len(x)), np.argwhere(near).tolist())
    assert near.sum() >= 6 * 12 * 23
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == [comp[i] for i in range(len(x))]


# ---- 7: personal data ------------------------------------------------------------------------------------------------


def test_base_kinds(spark):
    rng = random.Random(1)
    pieces = ["1", "22", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "255.255.0.1", "999", ".", "-", " ", "+1", "(", ")", "a", "b@c", "@", "x.y", ".com", "é", "\U0001f600", "%", "_", "+", "\n", "0", "+1 (988) 555-2485"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "1.2.3.4 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = personal_data.find_personal_data(df, {}).select("doc_id", personal_data.listed(F.col("pii_spans")).alias("s"), personal_data.redacted(F.col("text"), F.col("pii_spans")).alias("t")).collect()
    for r in found:
        want = brute.base_pii(texts[r["doc_id"]])[-1]
        assert r["s"] == want
        if not want:
            assert r["t"] == texts[r["doc_id"]]
    by = {r["doc_id"]: r["t"] for r in found}
    assert by[9002] == "[IP] " * 3000


def test_long_matches_and_many_spans(spark):
    """One match of a megabyte, and a hundred thousand spans in a text: no recursion, no quadratic work."""
    many = "x ana@b.de é " * 50_000 + "+1 555 123 4567 " * 30_000 + "1.2.3.4 " * 20_000
    rows = [(1, "a@b" + ".c" * 500_000), (2, many), (3, "a-" * 500_000), (4, "1 " * 400_000), (5, "token = " * 100_000), (6, "." * 300_000 + "1." * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = {k.name: personal_data.SpanModel([], 0.5, -1.0, [[0.0] * n for _, n in k.features(F.lit(""), F.lit(""), F.lit(""))]) for k in personal_data.ADDED}
    found = personal_data.find_personal_data(df, models)
    got = {r["doc_id"]: r for r in found.select("doc_id", F.size("pii_spans").alias("n"), personal_data.listed(F.col("pii_spans")).alias("s"), F.length(personal_data.redacted(F.col("text"), F.col("pii_spans"))).alias("left")).collect()}
    assert got[1]["s"] == f"email:0:{3 + 1_000_000}" and got[1]["left"] == len("[EMAIL]")
    assert got[2]["n"] == 50_000 + 1 + 20_000 or got[2]["n"] >= 70_000
    assert got[2]["s"] == brute.base_pii(many)[-1]
    assert [got[i]["n"] for i in (3, 4, 5)] == [0, 0, 0] and got[3]["left"] == 1_000_000


def test_running_sums(spark):
    for n in (0, 1, 511, 512, 513, 3000):
        values = F.array(*[]).cast("array<int>") if not n else F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7)
        got = spark.range(1).select(personal_data.running(values, F.lit(0), lambda a, b: a + b).alias("s")).first()["s"]
        assert got == [sum(i % 7 for i in range(1, k + 1)) for k in range(n)]


def test_redaction_across_pieces(spark):
    """Overlapping spans of several kinds, at and around the edges of the pieces that long texts are put together from."""
    rng = random.Random(3)
    for size in (0, 5, 1023, 1024, 1025, 5000):
        text = "".join(rng.choice("abé\n😀") for _ in range(size))
        cuts = [sorted((rng.randrange(size), rng.randrange(1, size + 1))) for _ in range(6)] if size else []
        cuts += [[1000, 1024], [1024, 1030], [2047, 2049]] if size > 2048 else []
        spans = sorted((a, b, "ip") for a, b in cuts if a < b)
        want, at = "", 0
        for a, b, k in spans:
            if a >= at:
                want += text[at:a] + "[IP]"
            at = max(at, b)
        want = want + text[at:] if spans else text
        df = spark.createDataFrame([(text, [("ip", a, b) for a, b, _ in spans])], "text string, spans array<struct<kind:string,start:int,end:int>>")
        assert df.select(personal_data.redacted(F.col("text"), F.col("spans"))).first()[0] == want


def test_values_of_keywords_names_and_addresses(spark):
    """Credentials of any alphabet after a keyword; names and addresses by gazetteers and what stands around."""
    rng = random.Random(5)
    made = lambda: "".join(rng.choice("abcXYZ019/+.!") for _ in range(rng.randrange(9, 30))) + "aZ7/"
    rows = []
    for i in range(400):
        kind = i % 4
        rows.append((i, [f"aws_secret_access_key = {made()} end", f"Dear Mrs Anna Meier, hello", f"He lives at {i + 1} Long Oak Street, Boston and", "The secret of this. Plain Words Here and 1984 People"][kind]))
    rows += [(900, "password = hunter2!"), (901, "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), (902, "no secret here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = personal_data.fit(df)
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["pii_spans"]] for r in personal_data.find_personal_data(df, models).collect()}
    texts = dict(rows)
    told = lambda i: [(k, texts[i][a:b]) for k, a, b in got[i]]
    assert all([k for k, _ in told(i)] == [["secret"], ["name"], ["address"], []][i % 4] for i in range(400))
    assert told(1) == [("name", "Anna Meier")] and told(2) == [("address", "3 Long Oak Street")]
    assert told(900) == [("secret", "hunter2!")] and told(901) == [("secret", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")] and told(902) == []


def test_secrets_are_learned(spark, docs):
    rng = random.Random(8)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(300):
        kind = i % 3
        word = hexed(32) if kind == 0 else f"release-{rng.randrange(100, 9999)}-b{rng.randrange(9)}"
        rows.append((i, f"some words password={word} and more" if kind == 0 else f"see version {word} of this" if kind == 1 else "plain words only"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal_data.fit(df)
    got = {r["doc_id"] for r in personal_data.find_personal_data(df, model).where("size(pii_spans) > 0").collect()}
    assert got == {i for i in range(300) if i % 3 == 0}
    assert personal_data.fit(empty(docs)) == {}
    assert personal_data.find_personal_data(odd(spark), model).count() == 5


# ---- 8: quality ------------------------------------------------------------------------------------------------------


def test_kneser_ney_adds_up(spark):
    """The probabilities of all bytes after any context add up to 1."""
    text = b"the cat sat on the mat and the dog sat on the log " * 3
    own = quality.text_grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    keys, n = np.unique(own, return_counts=True)
    contexts = {int(keys[5]) >> 8, int.from_bytes(b"e ca", "big"), int.from_bytes(b"zzzz", "big")}
    asked = sorted({c << 8 | b for c in contexts for b in range(256)} | set(keys.tolist()))
    counts = spark.createDataFrame([(k, int(dict(zip(keys.tolist(), n.tolist())).get(k, 0))) for k in asked], "gram long, n long")
    got = {r["gram"]: r["logp"] for r in quality.log_probabilities(counts, counts).collect()}
    for c in contexts:
        assert sum(math.exp(got[c << 8 | b]) for b in range(256)) == pytest.approx(1.0, abs=1e-9)


def test_quality(spark, docs):
    rng = random.Random(2)
    good = [(i, prose(rng, 80, 60), "en" if i % 2 else "xx") for i in range(400)]
    bad = [(1000 + i, "".join(chr(rng.randrange(33, 120)) for _ in range(300)), "en") for i in range(30)]
    extra = [(3000, None, "en"), (3001, "", None), (None, prose(rng, 50, 60), None), (5, good[5][1], "en")]
    df = spark.createDataFrame(good + bad + extra, "doc_id long, text string, lang string")
    trusted = spark.range(0, 300).toDF("doc_id")
    got = quality.judge_quality(df, trusted).collect()
    assert len(got) == len(good + bad + extra)
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["keep"] for i in range(300, 400)) >= 95 and not any(by[1000 + i]["keep"] for i in range(30))
    assert not by[3000]["keep"] and by[3000]["perplexity"] is None and by[None]["keep"]
    alone = quality.judge_quality(df.limit(5), trusted.where("doc_id < 0")).collect()
    assert all(r["keep"] for r in alone)
    assert quality.judge_quality(df.where("doc_id < 0"), trusted).count() == 0


def plain_kneser_ney(learned, text):
    """The mean surprise a byte of a text under a model of the learned texts, gram by gram."""
    from collections import Counter

    n = quality.ORDER
    pad = bytes([quality.START] * (n - 1))
    level = Counter(p[i : i + n] for t in learned for p in [pad + t] for i in range(len(t)))
    levels = {n: level}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off, around = {}, {}
    for k, own in levels.items():
        n1, n2, n3, n4 = (max(1, sum(c == x for c in own.values())) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x - (x + 1) * y * b / a, 0.1), x - 0.05) for x, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off[k] = lambda c, d=d: d[min(c, 3) - 1]
        around[k] = {}
        for g, c in own.items():
            total, freed = around[k].get(g[:-1], (0, 0.0))
            around[k][g[:-1]] = (total + c, freed + off[k](c))

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        if g[:-1] not in around[k]:
            return p(g[1:])
        total, freed = around[k][g[:-1]]
        c = levels[k].get(g, 0)
        return ((c - off[k](c) if c else 0) + freed * p(g[1:])) / total

    return -sum(math.log(p((pad + text)[i : i + n])) for i in range(len(text))) / len(text)


def test_quality_against_a_plain_model(spark):
    rng = random.Random(4)
    texts = {i: prose(rng, rng.randrange(1, 40), 50) for i in range(40)} | {50: "é" * 30, 51: "zzzz qqqq"}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.score_documents(df, spark.range(25).toDF("doc_id")).collect()}
    learned = [texts[i].encode() for i in texts if got[i]["trusted"] and not got[i]["held"]]
    assert 10 < len(learned) < 25
    for i, t in texts.items():
        assert math.log(got[i]["perplexity"]) == pytest.approx(plain_kneser_ney(learned, t.encode()), rel=1e-9)


def test_quality_sees_a_few_odd_words(spark):
    """One word in fifty that trusted text never has hardly moves the mean, but the tail."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 150, 60), "en") for i in range(400)]
    odd_rows = []
    for i in range(30):
        w = prose(rng, 150, 60).split()
        for k in range(0, 150, 50):
            w[k + rng.randrange(50)] = rng.choice(["filthy", "vermin", "idiots"])
        odd_rows.append((1000 + i, " ".join(w), "en"))
    df = spark.createDataFrame(rows + odd_rows, "doc_id long, text string, lang string").withColumn("tail", F.lit("x"))
    by = {r["doc_id"]: r for r in quality.judge_quality(df, spark.range(0, 300).toDF("doc_id")).collect()}
    assert sum(by[i]["keep"] for i in range(300, 400)) >= 95 and not any(by[1000 + i]["keep"] for i in range(30))


# ---- 9: language -----------------------------------------------------------------------------------------------------


def test_language_against_a_plain_network():
    """Pooled probabilities of texts of several lengths against one step at a time."""
    rng = np.random.default_rng(3)
    model = language_id.Model(["a", "b", "c"], language_id._init(3, 5, rng))
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in (1, 7, 127, 128, 129, 300)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language_id._pooled(model, np.concatenate(texts), offsets)
    w = {k: v.astype(float) for k, v in model.w.items()}

    def plain(part):
        logits = [w["c"].copy() for _ in part]
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h = np.zeros(5)
            for t in order:
                x, r = w[f"x{d}"][:, part[t]], w[f"u{d}"] @ h
                z, reset = np.clip(x[:5] + r[:5], 0, 1), np.clip(x[5:10] + r[5:10], 0, 1)
                new = np.tanh(x[10:] + reset * r[10:])
                h = z * h + (1 - z) * new
                logits[t] = logits[t] + w[f"o{d}"] @ h
        return [np.exp(v - v.max()) / np.exp(v - v.max()).sum() for v in logits]

    for t, p in zip(texts, got, strict=True):
        each = [v for a in range(0, len(t), language_id.SEGMENT) for v in plain(t[a : a + language_id.SEGMENT])]
        assert p == pytest.approx(np.mean(each, 0), abs=1e-4)


def test_language_sample_is_bounded_and_repeats(spark):
    rows = [(None if i % 3 else i, f"text {i % 50}", f"l{i % 4}") for i in range(900)] + [(i, "x", f"rare{i}") for i in range(230)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = language_id.training_rows(df, 20)
    assert a == language_id.training_rows(df.repartition(7), 20)
    assert len(set(a[1])) == 234 and max(a[1].count(f"l{k}") for k in range(4)) <= 20


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id._init(3, 4, rng).items()}
    x, y = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 3, 5)

    def loss(w):
        m = language_id.Model(["a", "b", "c"], w)
        p = language_id.position_probabilities(m, np.ascontiguousarray(x.T), np.full(5, 7))
        return -np.log(p[y, :, np.arange(5)]).mean()

    grads = language_id._gradients(w, x, y)
    for k in ("xf", "ub", "of", "c"):
        g, flat = grads[k].ravel(), w[k].ravel()
        for i in np.argsort(-np.abs(g))[:3]:
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss(w)
            flat[i] = old - eps
            down = loss(w)
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / (2 * eps), rel=0.08, abs=2e-4)


def test_language(spark, docs):
    rng = random.Random(6)
    sounds = {"aa": ["ba", "lu", "mo", "ti"], "bb": ["sch", "ür", "ent", "kr"], "cc": ["да", "не", "то"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[n]) for _ in range(3)) for _ in range(rng.randrange(5, 60))), n) for i in range(600) for n in [sorted(sounds)[i % 3]]]
    df = spark.createDataFrame(rows + [(700, None, "aa"), (701, "", None), (702, "123 456", None), (703, rows[0][1] * 200, None)], "doc_id long, text string, lang string")
    model = language_id.fit(df.where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held) > 50
    assert {r["doc_id"] for r in df.where(language_id.held_out()).collect()} >= set(held)
    assert [got[i]["lang_pred"] for i in (700, 701, 702)] == ["und"] * 3 and got[703]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.fit(empty(docs))
    assert {r["lang_pred"] for r in language_id.predict(df.limit(5), none).collect()} == {"und"}
    one = language_id.fit(df.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_id.predict(df.where("doc_id < 5"), one).collect()} == {"aa"}
    assert language_id.with_language(odd(spark), model, "_a", "_b").count() == 5


# ---- 10: Jaccard join ------------------------------------------------------------------------------------------------


def test_jaccard(spark, docs, rows):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=lambda r: r[0])
    want = brute.jaccard_components(rows)
    assert got == want and sum(c != d for d, _, c in want) > 10


@pytest.mark.parametrize("part", [4000, 7])
def test_jaccard_near_copies(spark, monkeypatch, part):
    """Near copies of near copies in one block, whole or dealt out in parts."""
    monkeypatch.setattr(jaccard_join, "PART_SETS", part)
    rng = random.Random(9)
    rows, texts = [], [prose(rng, 60, 3000) for _ in range(4)]
    for i in range(60):
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10)}"
        texts.append(" ".join(w))
        rows.append((i, texts[-1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
    assert got == brute.jaccard_components(rows)


def test_prefix_tree(monkeypatch):
    """Components of random sets, some of whose n-grams no other set holds, against all pairs; also in small slices."""
    rng = np.random.default_rng(1)
    for case in range(40):
        monkeypatch.setattr(jaccard_join, "LOOKUPS", (1 << 21, 64)[case % 2])
        base = [rng.choice(400, rng.integers(1, 150), replace=False) for _ in range(3)]
        sets, size = [], []
        for _ in range(rng.integers(2, 60)):
            own = base[rng.integers(3)]
            own = np.unique(np.concatenate([own[rng.random(len(own)) < rng.choice([1, 0.97, 0.92])], rng.integers(0, 400, rng.integers(0, 6)), rng.choice(400, 1)]))
            sets.append(own.astype(np.uint64))
            size.append(len(own) + int(rng.integers(0, 4)))
        got = jaccard_join.block_labels(sets, np.array(size), 85)
        links = []
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= 85 * (size[i] + size[j] - both):
                    links.append((i, j))
        want = brute.components(range(len(sets)), links)
        assert got.tolist() == [want[i] for i in range(len(sets))]


def test_jaccard_repeated_ids(spark):
    """Two texts under one doc_id link what either of them links."""
    a, b = "a b c d e f g h i j k l m n", "o p q r s t u v w x y z"
    rows = [(1, a), (5, a), (5, b), (7, b), (8, b + " z1"), (9, "else " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grams", F.lit(1)).withColumn("block", F.lit(2))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {(1, 11, 1), (5, 11, 1), (5, 9, 1), (7, 9, 1), (8, 10, 1), (9, 1, 9)}
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 9]


def test_jaccard_odd_tables(spark, docs):
    got = jaccard_join.jaccard_components(odd(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 5, 0), (1, 5, 1), (1, 5, 1), (2, 0, 2), (3, 0, 3)]
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0
    one = jaccard_join.one_of_each(odd(spark))
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 2, 3] and one.columns == odd(spark).columns


# ---- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as P

    raw = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in raw.collect()]
    steps, given = {}, raw
    for name, stage in P.STAGES:
        given = common.saved(stage(spark, given, SMALL))
        steps[name] = given
        if name != P.STAGES[-1][0]:
            assert given.columns == raw.columns
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in steps.items()}
    assert ids["language_id"] == {d for d, t in texts if any(c.isalpha() for c in t or "")}
    shingled = {d: brute.shingles(t, 5) for d, t in texts if d in ids["language_id"]}
    links = [(a, b) for a in shingled for b in shingled if b < a and shingled[a] and 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b])]
    root = brute.components(shingled, links)
    assert ids["jaccard_join"] == {d for d in shingled if root[d] == d}
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    holds = {d for d, t in texts if any(b in t for b in bench)}
    assert not ids["decontaminate"] & holds and len(ids["jaccard_join"] - ids["decontaminate"] - holds) <= 2
    assert ids["personal_data"] == ids["decontaminate"] == ids["mix"]
    clean = {r["doc_id"]: r["text"] for r in steps["personal_data"].collect()}
    assert all(brute.base_pii(t)[:2] == (0, 0) for t in clean.values())
    final = P.run(spark, SMALL)
    assert {(r["doc_id"], r["mix_taken"]) for r in final.select("doc_id", "mix_taken").collect()} == {(r["doc_id"], r["mix_taken"]) for r in steps["mix"].select("doc_id", "mix_taken").collect()}


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_reads_the_shared_folder_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert hashlib.sha256(b"").hexdigest()  # digests are of whole texts


def odd_corpus(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and names that the stages use inside."""
    rng = random.Random(12)
    text = prose(rng, 60)
    data = [
        (1, text, "en", "x", 15), (1, text, "en", "x", 15), (2, text, "en", "y", 15), (3, None, "de", None, 0), (4, "", None, "y", 0), (None, text + " more", None, None, None), (None, None, None, None, None),
        (5, prose(rng, 60_000), "en", "x", None), (6, "mail ana@b.example now " + prose(rng, 30), "en", "z", 1), (7, "12 34 !!", "en", "x", 8), (8, prose(rng, 80), "en", "x", 3), (8, prose(rng, 80), "en", "x", 3),
    ]
    names = ("_lang_pred", "_lang_score", "_pii_spans", "_pii_text", "_pii_size", "_nth", "mix_key", "packed", "component", "block", "grams", "count", "size", "spans", "base", "a", "b", "n")
    return spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("own") for c in names})


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline as P

    docs = common.saved(odd_corpus(spark).repartition(3))
    want = {"language_id": [1, 1, 2, 5, 6, 8, 8, None], "jaccard_join": [1, 3, 4, 5, 6, 7, 8, None, None], "decontaminate": [1, 1, 2, 3, 4, 5, 6, 7, 8, 8, None, None], "personal_data": [1, 1, 2, 3, 4, 5, 6, 7, 8, 8, None, None], "mix": [1, 1, 2, 3, 4, 5, 6, 7, 8, 8, None, None]}
    for name, stage in P.STAGES:
        got = stage(spark, docs, SMALL)
        assert got.columns[: len(docs.columns)] == docs.columns
        rows = got.collect()
        assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == want[name], name
        assert all(r["block"] == r["_nth"] == r["mix_key"] == "own" for r in rows)
        if name == "personal_data":
            by = {r["doc_id"]: r for r in rows}
            assert "[EMAIL]" in by[6]["text"] and by[6]["n_chars"] == len(by[6]["text"]) and by[3]["text"] is None and by[4]["text"] == "" and by[8]["n_chars"] == 3
        nothing = stage(spark, docs.where("doc_id < -5"), SMALL)
        assert nothing.count() == 0 and nothing.columns == got.columns


def test_least_score_follows_the_languages():
    import corpus_pipeline as P

    assert P.least_score(1) == 0 and P.least_score(2) > 0.5 and 0.3 <= P.least_score(4) < 0.31 and P.least_score(1000) > 0.07
