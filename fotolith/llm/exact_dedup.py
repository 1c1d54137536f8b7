"""Exact duplicates by a log-structured merge index of digests, with SQL functions only.

Every task of a flush is a memtable: it writes its digests as a sorted run and shuffles nothing. The memtables of a batch form RUNS runs of
level 0, each with a filter (a bitmap) over its digests. When FANOUT runs of one level have gathered they are merged into one of the next,
which keeps the digest's one identifier that stays and its number of rows; filters are merged by OR. New rows ask the filters before a
run is read. Rows whose digest has more than one row are hits, told by a filter as well: only these are dealt out, and their bytes are
compared, so that two texts with one digest never count as equal. All other rows are answered where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bits_for, bitmap, either, marked
from .keep import with_groups
from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of level 0 that one batch is flushed as, and how many runs of a level are merged into one of the next.
RUNS, FANOUT = 4, 4


def normalised(text: Column) -> Column:
    """Lower case for A-Z alone; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def sha_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@dataclass
class Run:
    """Digests, each with the identifier that stays and its number of rows (level 0: a row for each document), and their filter."""

    rows: DataFrame
    filter: DataFrame


class DigestIndex:
    """The index of one or more batches of documents. keep: 'min' or 'max', which identifier of equal texts stays.

    digest_bytes under 32 shortens the digests, for tests of the byte verification; expected is the number of rows that filters are made for.
    """

    def __init__(self, spark: SparkSession, keep: str = "min", digest_bytes: int = 32, expected: int = 1 << 21):
        self.spark, self.keep, self.digest_bytes, self.bits = spark, keep, digest_bytes, bits_for(expected)
        self.scratch = Scratch(spark, "digests")
        self.levels: list[list[Run]] = [[]]

    def _digest(self, sha: Column) -> Column:
        return F.substring(sha, 1, self.digest_bytes)

    def _best(self) -> Column:
        return (F.min if self.keep == "min" else F.max)("doc_id").alias("doc_id")

    def insert(self, docs: DataFrame) -> DataFrame:
        """Flushes a batch (doc_id, text) and merges what has gathered. Gives the batch's rows (doc_id, sha, digest), as they were flushed."""
        rows = docs.select("doc_id", sha_of(F.col("text")).alias("sha"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"))
        flushed = self.scratch.table(rows.sortWithinPartitions("run", "sha"), partitions=["run"])
        flushed = flushed.withColumn("digest", self._digest(F.col("sha")))
        filters = self.scratch.table(bitmap(flushed, "digest", bits=self.bits, by=["run"]), partitions=["run"])
        for k in range(RUNS):
            rows = flushed.filter(F.col("run") == k).select("digest", "doc_id", F.lit(1).cast("long").alias("n"))
            self.levels[0].append(Run(rows, filters.filter(F.col("run") == k).drop("run")))
        for level in range(len(self.levels) + 1):
            while level < len(self.levels) and len(self.levels[level]) >= FANOUT:
                self._merge(level, self.levels[level][:FANOUT])
        return flushed.drop("run")

    def _merge(self, level: int, runs: list[Run]) -> None:
        """Runs of one level become one of the next."""
        rows, filters = runs[0].rows, runs[0].filter
        for r in runs[1:]:
            rows, filters = rows.unionByName(r.rows), filters.unionByName(r.filter)
        rows = self.scratch.table(rows.groupBy("digest").agg(self._best(), F.sum("n").alias("n")).sortWithinPartitions("digest"))
        self.levels[level] = [r for r in self.levels[level] if r not in runs]
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(Run(rows, self.scratch.table(either(filters))))

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def compact(self) -> Run:
        """Merges all runs of all levels into one."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [*([] for _ in self.levels), runs]
            self._merge(len(self.levels) - 1, runs)
        return self.runs()[0]

    def seen(self, docs: DataFrame) -> DataFrame:
        """The rows of docs (doc_id, text) whose digest the index holds, with first_id, the identifier that stays of all equal ones there.

        Each run's filter is asked first, so that rows which a run can't hold aren't dealt out for it. By digest, without the bytes.
        """
        asked = docs.withColumn("digest", self._digest(sha_of(F.col("text"))))
        out = None
        for run in self.runs():
            held = marked(asked, "digest", within=run.filter, bits=self.bits).filter("_in").drop("_in")
            found = held.join(run.rows.groupBy("digest").agg(self._best()).withColumnRenamed("doc_id", "first_id"), "digest")
            out = found if out is None else out.unionByName(found)
        pick = F.min if self.keep == "min" else F.max
        return out.groupBy("doc_id", "text", "digest").agg(pick("first_id").alias("first_id")).drop("digest")

    def decide(self, docs: DataFrame, flushed: DataFrame) -> DataFrame:
        """One row for each row of docs, all of which the index must hold: doc_id, keep_id, group_size, kept, sha.

        flushed: the rows as insert() gave them.
        """
        many = self.scratch.table(self.compact().rows.filter("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")))
        repeated = self.scratch.table(bitmap(many, "digest", bits=self.bits))
        told = marked(flushed, "digest", within=repeated, bits=self.bits)
        groups, clash = self._verified(docs, many, repeated)
        alone = told.filter("NOT _in").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        # Rows that pass: with their groups, or alone again if the filter let them pass without one.
        asked = with_groups(told.filter("_in").drop("_in"), many, "digest", "group_size", self.scratch)
        if not clash.isEmpty():
            own = docs.select("doc_id", sha_of(F.col("text")).alias("sha"), normalised(F.col("text")).alias("text")).withColumn("digest", self._digest(F.col("sha")))
            own = own.join(clash, "digest", "left_semi").join(groups.withColumnRenamed("doc_id", "keep_id"), ["digest", "text"])
            asked = asked.join(clash, "digest", "left_anti").unionByName(own.select(*asked.columns))
        asked = asked.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha")
        mine = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        # Rows that tie in the identifier that stays: one of them does.
        ties = asked.filter(mine).groupBy("sha", "doc_id", "keep_id", "group_size").agg(F.count("*").alias("n"))
        nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")
        first = ties.select("*", nth).select("doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "sha")
        return alone.unionByName(asked.filter(~mine).withColumn("kept", F.lit(False)).select(*alone.columns)).unionByName(first)

    def _verified(self, docs: DataFrame, many: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The groups by the bytes themselves (digest, text, doc_id, group_size), and the digests that have several texts.

        Texts are grouped where they are read first, so that of many copies few are dealt out.
        """
        text = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", self._digest(F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
        held = marked(text, "digest", within=repeated, bits=self.bits).filter("_in")
        same = held.groupBy("digest", "text").agg(self._best(), F.count("*").alias("group_size"))
        return same, self.scratch.table(same.groupBy("digest").count().filter("count > 1").select("digest"))


def exact_duplicates(docs: DataFrame, keep: str = "min", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept and sha (binary) for every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts are one group, very long ones are read whole. A null doc_id gives way to any other; of rows that tie in text and
    doc_id one is kept. No rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    index = DigestIndex(docs.sparkSession, keep, digest_bytes, docs.count())
    return index.decide(docs, index.insert(docs))
