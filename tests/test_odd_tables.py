"""Plans against their SQL on documents without words, of odd spaces and signs, and without labels."""

import duckdb
import pytest
from test_parity import told

from rankprep import plans

TEXTS = ["a b c", "", " ", "\n\n", None, "", 'say "yes" or "', '"', "x\x0by z", "tab\tand\r\nline", " led by a space", "back \\ slash\\", "~ a~b ~", "\\N", "# no", "é ü   x\u0085y", "ends ", "", "0 1:2 3"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, text, "en", (None, "", "web", " a ")[i % 4], len(text or "")) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, i // 2 % 2) for i in range(0, len(TEXTS), 3)] + [(5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").coalesce(1).write.parquet(f"{at}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["s1_field_schema", "s5_read_sparse_multilabel", "s6_check_header", "s6_header_agreement", "p10_shift_for_pad"])
def test_documents_without_words(spark, odd, name):
    at, con = odd
    df = plans.QUERIES[name](spark, at)
    columns = sorted(df.columns)
    got = sorted("|".join(told(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert got == sorted("|".join(told(r[names.index(c)]) for c in columns) for r in cur.fetchall())
