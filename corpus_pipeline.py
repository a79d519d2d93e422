"""From raw documents to a training mix: five stages, each written and reread.

1. quality: documents that the byte-level network scores under 0.3 go.
2. near_duplicates: of each component of documents linked by an 80 % Jaccard
   similarity of 5-word shingles, the one with the least doc_id stays.
3. decontamination: documents that hold 80 % or more of a benchmark item's
   5-word shingles go.
4. secrets: spans that look like secrets are replaced in the text; no document
   goes, ``n_chars`` follows the new text.
5. mixture: which words a mix by source weights takes of the documents left.

Stages 1 to 4 return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridial.llm._work import cut, table
from meridial.llm.decontaminate import drop_contaminated
from meridial.llm.mixture import draw
from meridial.llm.quality import fit_quality, keep_quality
from meridial.llm.secrets import redact_secrets
from meridial.llm.set_join import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality; the network learns from the labels of this stage's input.

    A null or empty text is scored as one empty chunk; repeated rows score alike.
    """
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), least=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, whatever its doc_id; texts without words are kept."""
    return keep_one(docs, shingle=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, judged by their texts: null and repeated ids make no difference."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; null texts stay null, repeated rows stay."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and the output shards that get them.

    Null texts have size 0, a null source is one of its own, and rows with null
    or repeated ids are rows of their own.
    """
    drawn = draw(docs)
    return drawn.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: Stages 1 and 4 learn or compress, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
