"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns the rows that stay, with the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_matches
from .exact_dedup import exact_duplicates, sha_of
from .keep import aside, kept_rows, with_groups
from .mixing import mixed
from .ngram_join import ngram_classes
from .quality import GOOD, scored, train
from .scratch import Scratch

#: Shares of the mix; all other sources share the rest by their sizes.
TARGETS = {"src0": 0.15, "src1": 0.1, "src2": 0.1, "src3": 0.08}


def _present():
    """doc_id as a key that isn't null."""
    return F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))


def held_out():
    """Rows that no classifier learns from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those below GOOD, as in op8. Null and empty texts have one score and stay or go together; rows that tie
    or repeat are judged alike; without labels all weights are 0 and every score is one half; no rows give no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    weights = train(docs.select("doc_id", "text"), labels)
    return aside(docs, ("score",), lambda d: scored(d, weights).filter(F.col("score") >= GOOD))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id stays. Null and empty texts are one group; a null doc_id gives way to any other; of rows that tie in
    both one stays; no rows give no rows."""
    told = exact_duplicates(docs.select("doc_id", "text"), keep="min").select(_present().alias("_o"), F.col("sha").alias("_h"), "kept")
    return kept_rows(docs, told, {"_o": _present(), "_h": sha_of(F.col("text"))})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the least doc_id stays, of those that tie the one with the least hash of its text. Texts that are null or
    without words link with nothing and stay; no rows give no rows."""
    rows = ngram_classes(docs.select("doc_id", "text"), n=5, share=80)
    rows = rows.select(_present().alias("_o"), F.col("text_hash").alias("_h"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash").alias("order"), "component")
    scratch = Scratch(spark, "near")
    rows = scratch.table(rows)
    first = scratch.table(rows.groupBy("component").agg(F.min("order").alias("first"), F.count("*").alias("rows")))
    told = with_groups(rows, first, "component", "rows", scratch).select("_o", "_h", (F.col("order") == F.col("first")).alias("kept"))
    return kept_rows(docs, told, {"_o": _present(), "_h": F.xxhash64("text")})


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 10 consecutive words with a benchmark item go, or all words of a shorter item. Null and empty texts stay, rows that tie are
    judged alike; an empty benchmark takes nothing; no rows give no rows."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return aside(docs, ("n_words", "n_hit", "matches", "_words"), lambda d: benchmark_matches(d, tests, window=10).filter("n_hit = 0"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by TARGETS, with copy_no and mix_key. A null source has no target; rows that tie are repeated alike; no rows give no rows."""
    return mixed(docs, TARGETS)


STAGES = [("quality_classifier", quality_filter), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup), ("benchmark_decontamination", decontamination), ("mixing_sources", mixing)]
