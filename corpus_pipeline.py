"""A training-data pipeline over ``documents``, of the operators of ``tessera.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each stage's result to the shared folder and reads it for the next.

For all stages: columns beside those of documents play no part and are left out; an empty table gives an
empty result; a null text counts as an empty one; null ids are kept and told apart by their texts; equal
rows are rows of their own unless a stage says otherwise. Reruns over the same rows agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import balanced_mix, best_fit, compression_classifier, parity_join, secrets
from tessera.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the compression classifier accepts (a score of 0.5 or more).

    Equal texts have equal scores, so they stay or go together; an empty text has the score of no evidence.
    The labels are those of ``documents`` in ``sf_dir``, whatever rows come in.
    """
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = compression_classifier.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return compression_classifier.accept(docs, model).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by five-word shingles at 0.8: that of the least id.

    Null ids come after all others, then the least text hash decides; of rows with the same id and text
    one stays. Texts without words are in no group and all stay.
    """
    return parity_join.one_of_each(docs, parity_join.groups(docs, size=5, num=4, den=5)).select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live-looking secrets are masked in their texts, and ``n_chars`` follows.

    A text without such secrets, a null one too, stays as it is.
    """
    return secrets.without_live(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the balanced mix takes it, down to not at all.

    Null sources are one source. Of rows with the same id and text one stands for all, as often as they are
    taken together. Documents without words are taken by their source's share like others.
    """
    return balanced_mix.repeated(docs, balanced_mix.mix(docs)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: ``doc_id, piece, start, size, bin, place``.

    A document without words has one piece of size 0. Repeated rows have the same text, so they conflict and
    lie in different bins. Null sources conflict with nothing.
    """
    return best_fit.pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing sources to target weights", mix), ("best-fit packing", packing)]

#: Dictionaries of a compressor and drawn choices have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
