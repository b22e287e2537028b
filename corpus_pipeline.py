"""A training corpus from ``documents``, stage by stage.

Each stage is one operator over all that the stage before it kept; its result is
written as Parquet in the shared folder and read again. All but the last return
the columns of ``documents``. SQL cannot express the learned first stage, so
``ORACLE_SQL`` is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeline.llm import _fit, bpe, decontaminate, jaccard, suffix, toxicity
from scopeline.llm.queries import tokenizer_path
from scopeline.session import remove, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the model learns from labels as op8's does.

    Null and empty texts score as empty texts do and stay unless nearly all labels are toxic. Repeated rows and rows
    that share an id, null or not, are judged each by its own text. Without labels nothing goes; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), keep=_fit.remainder(4) != 2)
    return toxicity.below(docs.select(*COLUMNS), model, 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked documents, that of the least id, and every document without links.

    Rows with a null id are in nobody's way and stay, as do null, empty and wordless texts. Rows that share an id are
    judged each by its own text; of those that tie for the least id the text with the least SHA-256 stays, and of rows
    that repeat it one. An empty table stays empty.
    """
    return jaccard.representatives(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat a document of a smaller id; all rows stay.

    A cut can leave part of a character at its edge; such bytes go too. Null texts come back empty. A null id counts as
    larger than all others; rows that share an id never cut each other, so repeated rows stay whole. An empty table
    stays empty.
    """
    out = suffix.dedup(docs.select(*COLUMNS), carry=("lang", "source"), as_text=True)
    return out.select(*(F.col(n).cast(docs.schema[n].dataType) for n in COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Rows that share an id, a null one too, are judged each by its own text; null and empty texts contain nothing and
    stay; repeated rows go or stay together. An empty table on either side drops nothing.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every document left.

    Null and empty texts have no ids; repeated rows and null ids are encoded like others; an empty table stays empty.
    """
    return bpe.encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("tokens", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    base, last = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
