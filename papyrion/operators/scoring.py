"""Aggregated scores, comparisons of runs, and reliability of engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_matrix(scores: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """The mean score of each (row, column); failed runs have a null score and stay out of it."""
    return scores.groupBy(row).pivot(column, columns).agg(F.avg(value))


def best_per(scores: DataFrame, by: str, what: str, value: str) -> DataFrame:
    """For each group what scores best on average, the first by name of equals."""
    means = scores.groupBy(by, what).agg(F.avg(value).alias("mean")).where(F.col("mean").isNotNull())
    top = means.groupBy(by).agg(F.max("mean").alias("mean"))
    return means.join(top, [by, "mean"]).groupBy(by, "mean").agg(F.min(what).alias(what))


def pair_means(scores: DataFrame, pair: str, value: str) -> DataFrame:
    """Means of each pair, and of all rows under a null pair."""
    return scores.groupingSets([[F.col(pair)], []], pair).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def regressions(baseline: DataFrame, current: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Keys whose score fell by more than the tolerance or is missing."""
    both = baseline.select(key, F.col(value).alias("was")).join(current.select(key, F.col(value).alias("now")), key, "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was") - F.col("now") > tolerance, "regressed")
    return both.withColumn("state", state).where("state is not null")


def scorecard_diff(baseline: DataFrame, current: DataFrame, key: str = "doc") -> DataFrame:
    """One row for each way a document's scorecard got worse: fewer formulas, tables or cells, more flagged blocks, an order no longer monotonic, chrF down by over 1.0, or no card at all."""
    names = ("formulas", "tables", "table_cells", "flagged", "monotonic", "chrf")
    b, c = (d.select(key, F.struct(*names).alias(a)) for d, a in ((baseline, "b"), (current, "c")))
    both = b.join(c, key, "left")
    v = lambda side, name: F.col(f"{side}.{name}")
    worse = {
        "missing": F.col("c").isNull(),
        **{n: v("c", n) < v("b", n) for n in ("formulas", "tables", "table_cells")},
        "flagged": v("c", "flagged") > v("b", "flagged"),
        "monotonic": v("b", "monotonic") & ~v("c", "monotonic"),
        "chrf": v("b", "chrf") - v("c", "chrf") > 1.0,
    }
    hits = F.filter(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.lit(n)) for n, w in worse.items())), lambda x: x.isNotNull())
    return both.select(key, F.explode(hits).alias("worse"))


def history_delta(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each entry's change against the last entry of the same series that has a value."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("delta", F.col(value) - before)


def breaker(outcomes: DataFrame, engine: str, order: str, failed: Column, threshold: int = 2) -> DataFrame:
    """Failures in a row up to each outcome, and whether the breaker is tripped after it. A success starts anew."""
    w = Window.partitionBy(engine).orderBy(order)
    runs = outcomes.withColumn("failed", failed).withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    count = F.sum(F.col("failed").cast("long")).over(Window.partitionBy(engine, "island").orderBy(order))
    return runs.withColumn("failures", count).withColumn("tripped", count >= threshold).drop("island")


def live_first(engines: DataFrame, order: str = "ord") -> DataFrame:
    """Engines in their order, tripped ones last: none is dropped."""
    return engines.orderBy(F.col("tripped"), order)


def escalated(passes: DataFrame, by: str, order: str, quality: str, good: float = 0.6, margin: float = 0.1) -> DataFrame:
    """The pass that counts: from the first on, a later one takes over if it's better by the margin, until one is good."""
    rows = passes.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(quality).alias("q")))).alias("p"))
    start = F.struct(F.col("p")[0]["at"].alias("at"), F.col("p")[0]["q"].alias("q"))
    take = lambda s, x: F.when((s["q"] < good) & (x["q"] > s["q"] + margin), F.struct(x["at"].alias("at"), x["q"].alias("q"))).otherwise(s)
    kept = F.aggregate(F.slice("p", 2, F.size("p")), start, take)
    return rows.select(by, kept["at"].alias(order), kept["q"].alias(quality))


def confidence(rows: DataFrame, by: str, conf: str) -> DataFrame:
    """Mean confidence (1 without any), the share below 0.6, and quality = mean − 0.3 × that share."""
    weak = F.avg(F.when(F.col(conf) < 0.6, 1.0).otherwise(0.0))
    out = rows.groupBy(by).agg(F.coalesce(F.avg(conf), F.lit(1.0)).alias("mean"), F.coalesce(weak, F.lit(0.0)).alias("weak"), F.count(conf).alias("n"))
    return out.withColumn("quality", F.when(F.col("n") == 0, -1.0).otherwise(F.col("mean") - 0.3 * F.col("weak")))


def word_blocks(words: DataFrame, by: list[str], order: str, text: str, conf: str, box: tuple[str, str, str, str]) -> DataFrame:
    """Recognised words gathered to blocks: text in order, mean confidence, hull of the boxes."""
    x0, y0, x1, y1 = box
    gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return words.groupBy(*by).agg(F.array_join(F.transform(gathered, lambda w: w["t"]), " ").alias("text"), F.avg(conf).alias("conf"), F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


def otsu(values: DataFrame, value: str) -> DataFrame:
    """The threshold of 256 grey levels with the greatest variance between classes, the first of equals."""
    spark = values.sparkSession
    bins = values.groupBy(F.col(value).cast("int").alias("t")).agg(F.count("*").alias("n"))
    every = spark.range(256).select(F.col("id").cast("int").alias("t")).join(bins, "t", "left").na.fill({"n": 0})
    # 256 rows, whatever the input
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = every.select("t", F.sum("n").over(w).alias("w0"), F.sum(F.col("t") * F.col("n")).over(w).alias("s0"), F.sum("n").over(all_rows).alias("w"), F.sum(F.col("t") * F.col("n")).over(all_rows).alias("s"))
    apart = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    scored = at.where("w0 > 0 and w > w0").withColumn("v", F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * apart * apart)
    return scored.agg(F.max_by("t", F.struct("v", -F.col("t"))).alias("threshold"))


def structure(blocks: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """A1: blocks by kind, cells, what can be translated, what is flagged, and whether reading order never falls."""
    fixed = ("formula", "figure", "code")
    back = F.lag("reading_order").over(Window.partitionBy(by).orderBy(order)) > F.col("reading_order")
    kind = F.col("type")
    return blocks.withColumn("back", back).groupBy(by).agg(
        F.count("*").alias("blocks"), *(F.count_if(kind == k).alias(f"n_{k}") for k in ("paragraph", "heading", "formula", "table", "figure")), F.coalesce(F.sum("cells"), F.lit(0)).alias("table_cells"),
        F.count_if(~kind.isin(*fixed) & (F.trim("text") != "")).alias("translatable"), F.count_if(F.size("flags") > 0).alias("flagged"), (~F.bool_or(F.coalesce("back", F.lit(False)))).alias("monotonic"),
    )
