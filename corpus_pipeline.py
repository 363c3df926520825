"""The corpus pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage gets what its predecessor kept and returns the columns of ``documents``
(the last one returns packed pieces).  ``run`` writes each stage's result to the
shared folder as Parquet, reads it again for the next, and deletes what no later stage reads.

In all stages rows are judged as rows, also where ids repeat or are null; columns beside those of ``documents`` are
dropped, whatever their names; an empty table gives an empty one; texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm import minhash, packing, quality, substring, toxicity
from matchweave.llm.shared import Workspace, bounded_batches, broadcast_if_small, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(found: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` with the text of a column; n_chars follows it."""
    return found.select("doc_id", F.col(text).alias("text"), "lang", "source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail.  A null text has no words, so it goes.

    The verdict goes through a generator, as the optimiser would otherwise judge each text twice: once for the filter, once for the columns.
    """
    judged = quality.judge(docs, with_text=True, keep=("lang", "source"))
    once = judged.select(F.inline_outer(F.array(F.struct("doc_id", "clean_text", "lang", "source", "kept"))))
    return _documents(once.filter("kept"), "clean_text")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the labels are learned on the documents of this stage.  Null and empty texts get the score
    of the bias.  Rows with one id share its label; a label without a document is not used."""
    model = toxicity.learn(docs, table(bounded_batches(spark), sf_dir, "labels"), positive=1000, negative=3000)
    return toxicity.score(docs, model, keep=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id, a null id last, then with the smallest
    digest of its text.  Which one stays depends on the group alone, whatever ids other rows have.

    Where ids repeat or are null, rows are numbered, so that different texts with one id are different nodes; the rule is the same.
    Null and empty texts are no duplicates of anything.
    """
    space = Workspace(bounded_batches(spark), "pipeline-minhash")
    # the ids that go are few beside the texts: while they are small they are sent to these, which then need no shuffle
    scope = Workspace(spark, "pipeline-minhash-links")
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        name = "doc_id"
        gone = space.table(minhash.near_duplicates(docs, scope, n=5, percent=80, doc_id=name).filter("NOT kept").select(name), "gone")
    else:
        name = "row"
        docs = space.table(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
        links = space.table(minhash.near_duplicates(docs, scope, n=5, percent=80, doc_id=name).select("row", "component_id"), "links")
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2("text", 256).alias("digest"), "row")
        stay = links.join(docs.select("row", rank.alias("rank")), "row").groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
        gone = space.table(links.select("row").join(stay, "row", "left_anti"), "gone")
    scope.clear()
    return docs.join(broadcast_if_small(gone), name, "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that occur elsewhere too; a document that has none is unchanged.  A null text becomes an empty one."""
    return _documents(substring.remove_repeats(docs, Workspace(bounded_batches(spark), "pipeline-substring"), size=35, with_text=True, keep=("lang", "source")), "kept_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of a power of two of tokens; an empty or null text is one piece, the end id."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), longest=2048, end_id=1)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("MinHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("packing", packed)]

#: The model of the toxicity stage, hashes and tokens are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = space.table(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            space.drop(f"stage-{number - 1}")
    return docs
