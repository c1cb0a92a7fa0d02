"""The corpus pipeline: quality rules, quality classifier, exact and near dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``: doc_id, text, lang, source, n_chars.  A stage's scratch tables lie in a
folder of its own, on which its result depends: stages can be composed without a write between
them, and runs over one input can go on side by side.  ``run`` removes a stage's folder when it has
written the result.  For who calls stages one by one, each removes the folders of those before
whose DataFrame is gone and that its own input does not read; so hold on to a stage's DataFrame
while frames made from it are in use.  ``scratch.clear`` removes all.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm.exact_dedup import distinct_documents
from voxelweave.llm.importance import important_documents
from voxelweave.llm.near_dedup import distinct_groups
from voxelweave.llm.packing import pack_documents
from voxelweave.llm.quality_rules import clean_documents
from voxelweave.llm.scratch import Scratch, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Scratch folders of stages: application, Scratch, and the stage's DataFrame if it still exists.
KEPT: dict[str, tuple[str, Scratch, weakref.ref]] = {}


def with_scratch(spark: SparkSession, name: str, docs: DataFrame, operator: Callable[[Scratch], DataFrame]) -> DataFrame:
    """The result of an operator with a scratch folder of its own; folders that nothing needs go."""
    application, read = spark.sparkContext.applicationId, docs.inputFiles()
    for root, (of, scratch, result) in list(KEPT.items()):
        folder = root.rpartition("/")[2]
        if of == application and result() is None and not any(f"/{folder}/" in file for file in read):
            del KEPT[root]
            scratch.close()
    scratch = Scratch(spark, f"stage-{name}")
    out = operator(scratch)
    out._stage_input, out._stage_root = docs, scratch.root
    KEPT[scratch.root] = (application, scratch, weakref.ref(out))
    return out


def release(found: DataFrame) -> None:
    """Removes the scratch folder of a stage whose result has been written."""
    KEPT.pop(found._stage_root)[1].close()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules, and boilerplate lines from the others.

    Null and empty texts go; null sources stay null; repeated rows count each and stay repeated.
    """
    return with_scratch(spark, "quality_rules", docs, lambda scratch: clean_documents(docs, scratch=scratch))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that importance resampling towards the labelled good texts leaves out.

    Null and empty texts weigh 0; rows that repeat doc_id and text stay or go together.
    """
    labels = read_table(spark, sf_dir, "labels")
    return with_scratch(spark, "quality_classifier", docs, lambda scratch: important_documents(docs, labels, scratch))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id; null counts as empty, a null doc_id is
    the smallest, and of repeated rows one stays."""
    return with_scratch(spark, "exact_dedup", docs, lambda scratch: distinct_documents(docs, scratch))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) keeps one document.

    Texts without words stay, each by itself; of repeated rows one stays.
    """
    return with_scratch(spark, "near_dedup", docs, lambda scratch: distinct_groups(docs, scratch=scratch))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; rows are pieces, one at least a document."""
    return with_scratch(spark, "packing", docs, lambda scratch: pack_documents(docs, scratch=scratch))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", packing),
]

#: Hashed n-gram models, sketches and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no rows, and further columns are ignored.

    What a stage wrote goes when the next has written its own; the tables that the result is read
    from stay until ``scratch.clear`` removes those of the application.
    """
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, one in STAGES[:-1]:
        before, found = docs, one(spark, docs, sf_dir)
        docs = scratch.put(found, name)
        release(found)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
