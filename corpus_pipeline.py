"""A corpus from raw documents: language, near duplicates, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All stages take null in any
column, very long texts, repeated rows, empty tables and further columns, whatever their names, which pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankprep.llm.common import free_name, release, saved
from rankprep.llm.decontaminate import without_contaminated
from rankprep.llm.jaccard_join import one_of_each
from rankprep.llm.language_id import UNKNOWN, fit, with_language
from rankprep.llm.mixing import mix_sources
from rankprep.llm.personal_data import find_personal_data, redacted
from rankprep.llm.personal_data import fit as fit_personal_data

#: Texts go whose best language stands out from an even guess by less than this share of what it could.
LEAST_LIFT = 0.07


def least_score(n_languages: int) -> float:
    """The probability below which a text is in none of the learned languages; with one language none is."""
    return 1 / n_languages + LEAST_LIFT * (1 - 1 / n_languages) if n_languages > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones, too) and those that no learned language fits go; the rest stays.

    Rows without a label get the language found (of equal ones the first by name). Repeated rows each get their result;
    where nothing can be learned all texts go.
    """
    label = free_name(docs.columns, "_lang_pred")
    score = free_name(docs.columns, "_lang_score")
    model = fit(docs)
    marked = with_language(docs, model, label, score)
    kept = marked.where((F.col(label) != UNKNOWN) & (F.col(score) >= least_score(max(1, len(model.languages)))))
    return kept.withColumn("lang", F.coalesce("lang", label)).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, by five-word shingles and a similarity of 0.8, the smallest doc_id stays.

    Null and empty texts are like no other and stay, as do rows with a null doc_id; of repeated rows of one doc_id one
    stays, that of the smallest text.
    """
    return one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a near copy of one, go; repeated ones go together. Null and empty texts
    hold nothing and stay; without items all stay."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; all rows stay, and n_chars follows a text that was changed.

    Null texts stay null, empty ones empty, texts without personal data as they are; repeated rows are changed alike.
    """
    spans, text, size = (free_name(docs.columns, x) for x in ("_pii_spans", "_pii_text", "_pii_size"))
    found = find_personal_data(docs, fit_personal_data(docs), spans)
    changed = F.size(spans) > 0
    out = found.withColumn(text, F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col(spans))))
    out = out.withColumn(size, F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars").cast("long")))
    kinds = dict(docs.dtypes)
    new = {"text": F.col(text), "n_chars": F.col(size).cast(kinds["n_chars"])}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document, beside the document's columns; null and empty texts have no words and
    nothing is taken of them, repeated rows and a null doc_id or source are documents and a source like others."""
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: The learned stages can't be told in SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
