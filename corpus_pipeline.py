"""The corpus pipeline: five stages over documents, each the next one's input.

Toxic documents go, one document of each group of near-duplicates stays, documents that leak a benchmark item go,
live-looking secrets are masked in the texts, and what is left is packed into training sequences. All stages but the last
return the columns of documents.

Defined results: documents with a null or empty text are clean, have no duplicates, leak nothing and hold no secret, so they are kept and packed as one
end token; rows without a doc_id are kept unless they are toxic or leak, and of rows that repeat a doc_id and are linked one stays; very long
texts are read whole in every stage; of a group the smallest doc_id stays; an empty table packs into nothing; further columns, whatever
their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import common, decontaminate, ngram_join, packing, secret_scan, toxicity

#: Documents with at least this score are toxic.
TOXIC = 0.3
#: Near-duplicates: words in a shingle and least similarity in percent. op6's own query keeps 3 words and 90 %.
WORDS, SIMILAR = 5, 80


def detoxified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model rejects. Labels teach by doc_id; held-out labels are never read."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, TOXIC)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; documents without a doc_id or words stay. Of rows that
    repeat a doc_id and are linked or equal one stays; those with unlike texts are told apart."""
    found = ngram_join.join(docs, WORDS, SIMILAR, sets=True)
    if ngram_join.repeated(docs.where("doc_id IS NOT NULL")):
        stays = found.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("set_id").alias("set_id")).select("doc_id", "set_id")
        own = ngram_join.tagged(docs.where("doc_id IS NOT NULL"), WORDS).dropDuplicates(["doc_id", "set_id"])
        return own.join(stays.hint("merge"), ["doc_id", "set_id"], "left_semi").select(docs.columns).union(docs.where("doc_id IS NULL"))
    gone = common.saved(found.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    # Only documents that may be among the duplicates are shuffled.
    maybe, certain = common.split(docs, gone, "doc_id")
    return certain.union(maybe.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item or window of one."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with live-looking secrets masked, and n_chars of the texts as they are then."""
    return secret_scan.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    parts = packing.pieces(docs)
    return packing.pack(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", detoxified),
    ("ngram_join", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", masked),
    ("packing", packed),
]

#: Learned scores, tries and byte-level tokens can't be expressed in SQL; tests/llm holds run() against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder, read again, and deleted when the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.discard(spark, f"pipeline-{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
