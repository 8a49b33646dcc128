"""A training corpus from raw documents, in five stages; each reads what the one before wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.graph import cut, remove, shared_dir
from strandweave.llm.jaccard_join import jaccard_components
from strandweave.llm.language_id import keep_identified
from strandweave.llm.line_dedup import line_dedup
from strandweave.llm.mixing import repeat_documents
from strandweave.llm.packing import pack_powers_of_two
from strandweave.llm.queries import tokenizer_path

#: The stages' production parameters.
MIN_SCORE, SHINGLE_WORDS, PERCENT, MAX_LENGTH = 0.5, 5, 80, 1024


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is less likely than not, go.

    So null and empty texts go; repeated rows and rows that share an id are judged each by its
    text. An empty table gives an empty one.
    """
    return keep_identified(docs, MIN_SCORE)


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of their texts, null for a null one, and the columns of ``like``."""
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and lines within an edit of an earlier one; blank lines stay.

    A document that loses all that it had goes with them; one that was null, empty or blank
    before stays as it is. Ties in rank, repeated rows, null ids and long texts are as
    :func:`line_dedup` has them; an empty table gives an empty one.
    """
    kept = line_dedup(docs)
    removed = F.col(kept.columns[-1])
    some = (F.size(removed) == 0) | F.coalesce(F.length(F.trim(F.translate("text", "\n\t\r", ""))) > 0, F.lit(False))
    return _with_length(kept.where(some), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: the least id, null last.

    Rows are told apart by a hash of all their columns and not by id, so null ids take part,
    and of rows that share an id with different texts each is judged on its own. Of fully
    equal rows one stays, whatever their text. Null, empty and wordless texts are else never
    near copies. An empty table gives an empty one; a text's shingles must fit in a task.
    """
    rows = docs.withColumn("__row", F.xxhash64(*docs.columns))
    found = jaccard_components(rows, k=SHINGLE_WORDS, percent=PERCENT, id_col="__row")
    group = found.select(F.col("doc_id").alias("__row"), "component_id").groupBy("__row", "component_id").agg(F.count(F.lit(1)).alias("times"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    ranked = cut(group.join(rows.select("__row", "doc_id").distinct(), "__row").select("__row", "component_id", "times", rank.alias("rank")))
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    drop = ranked.join(first, "component_id").where(F.col("rank") != F.col("first")).select("__row")
    again = ranked.join(first, "component_id").where((F.col("rank") == F.col("first")) & (F.col("times") > 1)).select("__row")
    stay = rows.join(drop, "__row", "left_anti")
    one = stay.join(again, "__row", "left_semi").dropDuplicates(["__row"])
    return stay.join(again, "__row", "left_anti").unionByName(one).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's share asks for; a partial last copy ends after its words.

    Rows without words have nothing to take and go; ties and repeated rows are as
    :func:`repeat_documents` has them. An empty table gives an empty one.
    """
    return _with_length(repeat_documents(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: one row a piece with its token ids, ``ids``, besides its document and place.

    A null or empty text is the end token alone; repeated rows are packed each. An empty
    table gives an empty one.
    """
    return pack_powers_of_two(docs, tokenizer_path(), MAX_LENGTH)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: No SQL: the classifier, the tokeniser and the Newton steps have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what a stage read is not needed once its own result is written
            remove(spark, before)
        before = path
    return docs
