"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last returns packed pieces. Every stage is one operator of
``weirflow.llm`` at work on all its rows:

1. quality: a classifier learned from ``labels`` scores each text; rows below
   the threshold go.
2. language: the language is predicted from the text; rows whose language can't
   be told (no letter, no language clearly ahead, or a code far longer than texts
   of the learned languages take) go. Rows without ``lang`` get the prediction. All
   rows with ``lang`` teach the languages and set what their texts take.
   Where no row has a language to learn from, all stay.
3. lines: lines of 40 characters and more that five documents or more hold stay
   only in the one with the largest id.
4. near_duplicates: of each group of documents linked by 0.8 Jaccard similarity
   of their five-word shingles, the one with the smallest id stays.
5. pack: what is left is tokenized and packed into sequences of 2048 tokens.

A null or empty text is scored like any other, has no language and goes in stage 2.
A null id is no label's and no copy of another row; rows that repeat an id are one
document: all of them stay or none, and each is packed. An empty table gives empty
results. Stages add no column and change none but ``lang`` (where it is null), and
``text`` and ``n_chars`` (where lines went); other columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weirflow.llm.common import UNMARKED, new_path, table
from weirflow.llm.jaccard_join import ngram_jaccard_join
from weirflow.llm.line_dedup import dedup_lines
from weirflow.llm.packing import pack_documents
from weirflow.llm.ppm_language import UNDETERMINED, code_limits, fit_languages, identify_languages
from weirflow.llm.quality import fit_quality, score_quality
from weirflow.llm.queries import tokenizer_file

MIN_QUALITY = 0.3
MIN_LANGUAGE_SHARE = 0.5
CAPACITY = 2048
#: Words whose ids a worker keeps while packing; workers go on to other stages.
HELD = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, score_out="__quality").where(F.col("__quality") >= MIN_QUALITY).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_languages(docs, max_rows=None)
    if not model.languages:
        return docs
    told = identify_languages(docs, model, limits=code_limits(docs), lang_out="__lang", score_out="__share")
    clear = told.where((F.col("__lang") != UNDETERMINED) & (F.col("__share") >= MIN_LANGUAGE_SHARE))
    return clear.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs, min_docs=5, min_chars=40, lines_out="__lines", dropped_out="__dropped")
    changed = F.when(F.col("__dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_jaccard_join(docs, n_words=5, percent=80)
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=CAPACITY, held=HELD)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("pack", pack),
]

#: A trained classifier, a language model of bytes and a search for few bins: no stage but ``lines`` is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.options(**UNMARKED).parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
