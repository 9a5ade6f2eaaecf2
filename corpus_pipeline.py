"""A corpus pipeline: language ID, line dedup, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``, whatever further columns there are and however they are named.
``n_chars`` is kept equal to the text's length where a stage changes the text. A stage
begins by having the executors give back what the one before left free (``give_back``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe_words, decontam, langid, linededup, ngramjoin
from pulsegrid.llm.common import Workspace, give_back, small_side

#: A document whose best cosine is below this has no language.
MIN_LANG_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: documents without a recognisable language go.

    A null, empty or letterless text has none. Rows with a null id teach nothing, and
    are judged as all others. Repeated rows are judged alike, so all stay or all go. A
    long text is judged whole. If nothing is labelled, every document goes.
    """
    give_back(spark)
    columns = docs.columns
    labelled = docs.filter(~langid.held_out("doc_id") & F.col("doc_id").isNotNull()).select("text", "lang")
    out = langid.predict(docs, langid.learn(labelled), extra=columns)
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANG_SCORE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: lines of three documents or more stay in the last one; every document stays.

    A null text becomes an empty one. Rows of equal id each count as a document; all with
    the largest id keep the line. Rows with a null id never keep it.
    """
    give_back(spark)
    columns = docs.columns
    out = linededup.drop_lines(docs, extra=[c for c in columns if c != "text"])
    rows = out.select("row.*", F.col("kept").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: of documents linked by five-word shingles at 0.8, the smallest id of each component stays.

    A document without words, or with a null id, links with nothing and stays. Rows of
    equal id are one document: all of them stay or go. Of equal texts the smallest id stays.
    """
    give_back(spark)
    found = ngramjoin.jaccard_join(docs, n=5, percent=80).documents
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: documents that hold a benchmark item go.

    Null texts and empty benchmarks hold nothing. Rows of equal id go together; rows with a
    null id stay, as they can't be named. Long texts are searched whole.
    """
    give_back(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontam.contaminated(docs, benchmark).select("doc_id").distinct()
    gone = Workspace(spark, "leaks").table(gone, "ids")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: token ids of what is left, with their count; one row a row, null texts as empty ones."""
    give_back(spark)
    return bpe_words.encode_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Language ID and encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is a stored table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.table(docs, f"{k}-{name}")
    return docs
