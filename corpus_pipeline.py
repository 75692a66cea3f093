"""The corpus pipeline: five of the training-data operators, one after the other, over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Filtering stages drop
the rows they reject and leave the others as they are; secrets are cut out of the text; the last
stage turns texts into piece ids.  Rows of ``docs`` with null or empty text pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thawline.llm import decontamination, jaccard_join, secret_scan, sentencepiece_codec, toxicity
from thawline.llm.common import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET_MARK = "[SECRET]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (trained on the labelled training fold) rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose 5-word shingle sets overlap by 0.8 or more, the
    least doc_id stays."""
    found = jaccard_join.jaccard_components(docs, n=5, num=80, den=100)
    gone = stash(found.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; n_chars follows where the text changes."""
    found = secret_scan.scan_secrets(docs, COLUMNS, mark=SECRET_MARK)
    changed = F.col("spans") != ""
    return found.select(
        "doc_id",
        F.when(changed, F.col("redacted")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with their number, the best path's log score and the round-trip check."""
    return sentencepiece_codec.encode_texts(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode),
]

#: A trained classifier, edit distances and a Viterbi search: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
