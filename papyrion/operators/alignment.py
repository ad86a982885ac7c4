"""Styles carried from source words to target words along a word alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions import text as T

# The least probability of a link in both directions, and the least share of aligned target words.
LINK, COVERAGE = 1e-3, 0.3


def linked(source: np.ndarray, target: np.ndarray) -> list[tuple[int, int]]:
    """Links of the rows of two matrices of word vectors: those whose softmax over the products is above LINK in both directions."""
    if not len(source) or not len(target):
        return []
    dot = source @ target.T
    forward, back = (np.exp(dot - dot.max(axis=k, keepdims=True)) for k in (1, 0))
    both = (forward / forward.sum(axis=1, keepdims=True) > LINK) & (back / back.sum(axis=0, keepdims=True) > LINK)
    return [(int(i), int(j)) for i, j in np.argwhere(both)]


def links(pairs: DataFrame, by: str = "id") -> DataFrame:
    """(id, s, t): linked words of each pair (id, source, target: arrays of word vectors), Arrow-batched, a pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = linked(np.array(a or []), np.array(b or []))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), batch.schema.field(0).type), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())], names=[by, "s", "t"])

    return pairs.select(by, "source", "target").mapInArrow(run, f"{by} {pairs.schema[by].dataType.simpleString()}, s int, t int")


def tagged_words(runs: DataFrame, by: str = "id", order: str = "run") -> DataFrame:
    """(id, s, word, style): words of a block's runs (id, run, text, style), numbered through the runs in order."""
    words = runs.select(by, order, "style", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("p", "word"))
    return words.withColumn("s", F.row_number().over(Window.partitionBy(by).orderBy(order, "p")) - 1).select(by, "s", "word", "style")


def restyled(runs: DataFrame, targets: DataFrame, pairs: DataFrame, by: str = "id") -> DataFrame:
    """(id, run, text, style): a translation (id, translated) as runs that carry the style of the source words which their words are linked to.

    A word takes the style that most of its linked words have, of equals the one of the first; a word without a link that
    of the word before it, the first ones that of the first styled word. Neighbours of one style are one run, white space
    goes with the word before it, so the runs' texts joined are the translation. Blocks of which fewer than COVERAGE of the
    words are linked are left out: they keep their runs.
    """
    sources = tagged_words(runs, by).select(by, "s", "style")
    tokens = targets.where(T.strip(F.coalesce("translated", F.lit(""))) != "").select(by, F.regexp_extract(F.col("translated"), r"(?U)^\s*", 0).alias("lead"), F.posexplode(F.regexp_extract_all("translated", F.lit(r"(?U)\S+\s*"), F.lit(0))).alias("t", "token"))
    votes = pairs.join(sources, [by, "s"]).groupBy(by, "t", "style").agg(F.count("*").alias("n"), F.min("s").alias("first"))
    style = votes.groupBy(by, "t").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "style"))["style"].alias("style"), F.lit(True).alias("linked"))
    words = tokens.join(style, [by, "t"], "left")
    enough = words.groupBy(by).agg((F.count_if("linked") >= F.greatest(COVERAGE * F.count("*"), F.lit(1))).alias("enough")).where("enough").select(by)
    w = Window.partitionBy(by).orderBy("t")
    carried = F.coalesce(F.last("style", ignorenulls=True).over(w), F.first("style", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = words.join(enough, by, "left_semi").withColumn("style", F.when(F.col("linked"), F.col("style")).otherwise(carried))
    rows = rows.withColumn("token", F.when(F.col("t") == 0, F.concat("lead", "token")).otherwise(F.col("token")))
    rows = rows.withColumn("run", F.sum(F.when(F.lag("style").over(w).eqNullSafe(F.col("style")) & (F.col("t") > 0), 0).otherwise(1)).over(w) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "token"))), lambda x: x["token"]), "")
    return rows.groupBy(by, "run", "style").agg(text.alias("text")).select(by, "run", "text", "style")

