"""Corpus pipeline: quality, line dedup, near dedup, decontamination, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.bpe import encode_ids
from tidegrid.llm.common import keep_columns, materialize, text_of
from tidegrid.llm.decontaminate import mark_contaminated
from tidegrid.llm.line_dedup import line_dedup
from tidegrid.llm.near_dedup import near_dedup
from tidegrid.llm.quality import score_quality, train

TOKENIZER = "byte_bpe_50k.json"
SHINGLE_WORDS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    model = train(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return keep_columns(docs, scored.filter(F.col(scored.columns[-1]) == 1))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; the length column follows."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length(text_of()).cast(kind))
    return keep_columns(docs, out)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup(docs, width=SHINGLE_WORDS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    marked = mark_contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return keep_columns(docs, marked.filter(F.size(marked.columns[-1]) == 0))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip (the ids decode to the text)."""
    return encode_ids(docs, public_tokenizers.path(TOKENIZER), "lang", "source")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The trained classifier cannot be written in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
