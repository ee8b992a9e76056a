"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``; where a stage changes a text, n_chars
is the length of the new one.

Every stage takes nulls in any column, empty and very long texts, repeated
rows, an empty table, and further columns with names that its operator uses
itself; what becomes of them is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weeklark.llm import decontam, jaccard, langid, linededup, packing
from weeklark.llm.common import Scratch, passing, table, unwrapped, wrapped
from weeklark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: learnt from the labelled documents of the stage's input; documents that it rejects go.

    Texts that are null, empty or without letters are rejected; repeated rows
    stay or go together; an empty table stays empty.
    """
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return unwrapped(langid.classify(wrapped(docs, "text"), model).filter(~F.col("rejected")), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines leave the texts; documents stay, with what is left of them.

    A null or empty text stays as it is; a text whose lines all go is empty;
    rows of null doc_id keep all lines; rows that repeat a doc_id lose the
    same lines, and count as one document.
    """
    kept = linededup.dedup_lines(wrapped(docs, "doc_id", "text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("__row.n_chars"))
    return unwrapped(kept, docs.columns, text=F.col("text"), n_chars=n_chars)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest doc_id stays.

    Null and empty texts link with nothing and stay, as do rows of null
    doc_id; rows that repeat the doc_id that stays all stay.
    """
    return jaccard.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go.

    Null and empty texts are clean; repeated rows stay or go together; an
    empty benchmark leaves all documents.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece, with its sequence and place.

    A null or empty text is one piece of the end id alone; repeated rows are
    pieces of their own; a null doc_id stays null; an empty table gives no
    rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("contamination", contamination), ("pack", pack),
]

#: Packing and the learnt classifier are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing():  # what the stage's operator wrote for itself goes once its result is written
            docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
