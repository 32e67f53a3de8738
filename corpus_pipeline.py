"""From raw documents to packed sequences.

Five stages, each on all that the one before kept: quality rules, toxicity,
near copies, benchmark decontamination, packing.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.llm import decontaminate, neardup, packing, quality, toxicity
from tableloom.llm.shared import pick, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go from their texts; documents that are rejected go whole."""
    # a filter on a computed column would compute it twice, a generator does so once
    judged = F.inline(F.filter(F.array(quality.figures(F.col("text"))), lambda q: q["kept"]))
    kept = pick(docs, "doc_id", *OTHERS, text="string").select("doc_id", *OTHERS, judged)
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def low_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where("score < 0.7").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays, in one row.

    Of rows of one doc_id the one with the smallest text stays, of rows
    without doc_id one for each text.
    """
    verdicts = neardup.near_copies(docs, shingle=5, percent=80)
    gone = written(verdicts.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    kept = pick(docs, *COLUMNS).join(_few(gone), "doc_id", "left_anti").select(*COLUMNS)
    several = written(kept.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "several")
    if several.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    rest = kept.join(_few(several), same, "left_semi")
    own = F.when(F.col("doc_id").isNull(), F.md5("text"))
    one = rest.groupBy("doc_id", own.alias("own")).agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(_few(several), same, "left_anti").union(one)


def _few(ids: DataFrame) -> DataFrame:
    """Ids for a broadcast where they are at most 2,000,000 (8 bytes each), else for a shuffle."""
    return F.broadcast(ids) if ids.count() <= 2_000_000 else ids


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark item's window of 10 words go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=OTHERS)
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids."""
    return packing.pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", low_toxicity),
    ("near copies", one_of_near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: A fitted model and tokenizers have no SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
