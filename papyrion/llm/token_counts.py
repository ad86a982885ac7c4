"""Token counts as delta-maintained rollups: signed changes add to totals by source, language and tokenizer version."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
#: The counters by tokenizer version: a native expression over the text column. Further versions are entries of such a dict.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]",
}


def count_tokens(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def counts(text: Column, tokenizers: dict[str, str] | None = None) -> Column:
    """An array of (tokenizer, n_tokens) for a text, one for each tokenizer version. Null text has 0 tokens; texts of any length are counted whole."""
    return F.array(*(F.struct(F.lit(v).alias("tokenizer"), count_tokens(text, p).alias("n_tokens")) for v, p in (tokenizers or TOKENIZERS).items()))


def counted(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): a row for each document and tokenizer version.

    Other columns of docs are left behind, also those named tokenizer or n_tokens; repeated rows give repeated counts,
    an empty table none.
    """
    return docs.select("doc_id", "source", "lang", F.inline(counts(F.col("text"), tokenizers)))


def deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed additive totals of a batch. before: count rows that go; after: count rows that come.

    An insert has only an after row, a delete only a before row, a revision both; all three are sums, so rows may
    come in any order and repeated rows count as often as they occur. Null keys are groups of their own.
    """
    signed = [d.select(*KEYS, F.lit(s).cast("long").alias("d_docs"), (F.lit(s) * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("d_tokens")) for d, s in ((before, -1), (after, 1)) if d is not None]
    return reduce(DataFrame.unionByName, signed).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))


class Rollup:
    """A log of committed batches in a folder that all executors share; totals are the sum over the log.

    A batch holds its sums, not its rows. Each attempt to commit it writes a folder of its own, which counts from the
    moment it is renamed to ``batch=<id>@<time>-<attempt>``. Of a batch's attempts the first by name counts, for every
    reader, so that repeated, resumed and concurrent commits of a batch count once on any file system, also where a
    rename can't be refused. All attempts at an id must bring the same change, as a retry does.
    """

    SCHEMA = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _attempts(self) -> dict[str, str]:
        """The folder that counts for each batch id."""
        if not self._fs.exists(self._path(self.folder)):
            return {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        found: dict[str, str] = {}
        for name in names:
            if name.startswith("batch="):
                found.setdefault(name.removeprefix("batch=").rpartition("@")[0], name)
        return found

    def committed(self, batch_id: str) -> bool:
        return batch_id in self._attempts()

    def commit(self, batch_id: str, change: DataFrame) -> bool:
        """Adds a batch of :func:`deltas`; False if it was there or another attempt came first. Zero sums are written too: an empty batch counts as committed."""
        if not batch_id or "/" in batch_id or "@" in batch_id:
            raise ValueError("a batch id is a non-empty name without a slash or @")
        if self.committed(batch_id):
            return False
        attempt = uuid.uuid4().hex
        staged = self._path(f"{self.folder}/_staged-{attempt}")
        change.select(*KEYS, "d_docs", "d_tokens").write.parquet(staged.toString())
        own = f"batch={batch_id}@{time.time_ns():020d}-{attempt}"
        if self.committed(batch_id) or not self._fs.rename(staged, self._path(f"{self.folder}/{own}")):
            self._fs.delete(staged, True)
            return False
        return self._attempts()[batch_id] == own

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches; groups that have come to nothing are left out."""
        found = [f"{self.folder}/{name}" for name in self._attempts().values()]
        if not found:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")
        rows = self.spark.read.schema(self.SCHEMA).parquet(*found)
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")
