"""Command line: run a query, convert files to blocks, keep a translation memory and a glossary as event logs.

    python -m papyrion query NAME SF_DIR OUT
    python -m papyrion convert FOLDER OUT [GLOB]
    python -m papyrion tm {put,confirm,correct} STORE PAIRS TGT_LANG | tm {stats,export,purge} STORE [OUT]
    python -m papyrion glossary {import,list,export} STORE [FILE]
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import memory as M
from papyrion.sources import containers as C
from papyrion.sources import tables as B


def _seq(df: DataFrame) -> DataFrame:
    """A number that grows from call to call; within a call, later rows of a partition count as later."""
    return df.withColumn("seq", F.lit(time.time_ns() // 1000) + F.monotonically_increasing_id())


def query(spark: SparkSession, name: str, sf_dir: str, out: str) -> None:
    from papyrion.plans.catalogue import QUERIES

    QUERIES[name](spark, sf_dir).write.mode("overwrite").parquet(out)


def convert(spark: SparkSession, folder: str, out: str, *globs: str) -> None:
    """C4: files of a folder as blocks."""
    rows = C.files(spark, folder, *globs).withColumn("kind", C.kind(F.col("path"), F.col("content")))
    C.blocks(rows.where(F.col("kind").isin(*C.READERS))).write.mode("overwrite").parquet(out)


def tm(spark: SparkSession, action: str, store: str, *rest: str) -> None:
    """Pairs come as TSV with columns src and tgt."""
    if action in ("put", "confirm", "correct"):
        pairs = _seq(spark.read.option("sep", "\t").option("header", "true").csv(rest[0]))
        M.puts(pairs, "seq", rest[1], kind={"put": "put", "confirm": "confirm", "correct": "correction"}[action], origin="user").write.mode("append").parquet(store)
        return
    view = M.memory(spark.read.parquet(store))
    if action == "stats":
        M.stats(view).show()
    elif action == "export":
        view.select(B.unit_markup(F.col("src_text"), F.col("tgt_text"), "x", "y").alias("value")).write.mode("overwrite").text(rest[0])
    elif action == "purge":
        M.purged(view).write.mode("overwrite").parquet(rest[0])
    else:
        raise SystemExit(__doc__)


def glossary(spark: SparkSession, action: str, store: str, *rest: str) -> None:
    """Entries come as CSV."""
    if action == "import":
        rows = _seq(B.glossary_csv(spark, rest[0]))
        rows.select("term", "src_lang", "tgt_lang", "domain", "rendering", "seq", F.lit("add").alias("kind"), F.lit("import").alias("origin"), F.lit(False).alias("locked")).write.mode("append").parquet(store)
        return
    view = M.glossary_view(spark.read.parquet(store))
    if action == "list":
        view.orderBy("term").show(1000, truncate=False)
    elif action == "export":
        view.select("term", "rendering", "src_lang", "tgt_lang", "domain").write.mode("overwrite").csv(rest[0])
    else:
        raise SystemExit(__doc__)


def main(args: list[str]) -> None:
    commands = {"query": query, "convert": convert, "tm": tm, "glossary": glossary}
    if len(args) < 3 or args[0] not in commands:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName("papyrion").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    commands[args[0]](spark, *args[1:])


if __name__ == "__main__":
    main(sys.argv[1:])
