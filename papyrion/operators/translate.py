"""Whole documents translated as one plan: memory, close matches, protected tokens, engines, restoring, checks, scatter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.functions import protect as P
from papyrion.functions import text as T
from papyrion.operators import memory as M
from papyrion.operators import segments as S
from papyrion.operators.documents import translatable
from papyrion.operators.engines import Engine, translated


@dataclass
class Plan:
    """What a run is asked for. fuzzy is the score from which a past translation is reused as it is; None reuses none."""

    source: str
    target: str
    chain: list[tuple[str, Engine]]
    glossary: dict[str, str] = field(default_factory=dict)
    fuzzy: float | None = 0.95
    suggest: float = 0.75
    ctx: str = ""


@dataclass
class Result:
    """blocks with tgt, origin and findings; suggestions: close past translations that weren't reused; events: what the memory learns."""

    blocks: DataFrame
    suggestions: DataFrame | None
    events: DataFrame


def translate(blocks: DataFrame, plan: Plan, tm: DataFrame | None = None) -> Result:
    """Blocks (doc, ord, type, text) translated.

    Texts that come again are one piece of work. A piece is taken from the memory if it's there, else from a past
    translation that is close enough and has the same protected tokens, else its protected tokens are put under tags, the
    engines of the chain translate it, and tokens, numbers, glossary and edge space are put right again. Every block gets
    its piece's translation and is checked; blocks that aren't translated have none. New translations are memory events
    (in the order of their keys).
    """
    wanted = blocks.where(translatable(F.col("type"), F.col("text")))
    work = S.distinct_work(wanted, "text")
    done, suggestions = [], None
    if tm is not None:
        known = M.exact(work.withColumnRenamed("key", "k"), tm, "text", plan.target, plan.source).withColumnRenamed("k", "key")
        done.append(known.where("tgt is not null").select("key", "tgt", F.lit("memory").alias("origin")))
        work = known.where("tgt is null").select("key", "text")
        if plan.fuzzy is not None:
            past = M.in_scope(tm, plan.target, plan.source).select(F.xxhash64("norm", "ctx", "domain", "src_lang").alias("c_id"), "norm", "tgt_text", "src_text")
            close = M.fuzzy(work.select(F.col("key").alias("q_id"), F.col("key").alias("norm")), past, least=plan.suggest, top=1)
            close = close.join(past.select("c_id", "src_text"), "c_id").join(work.withColumnRenamed("key", "q_id"), "q_id")
            close = M.reuse(close.withColumn("same_tokens", F.pandas_udf(_same, "boolean")("text", "src_text")))
            reused = close.where((F.col("tier") == "auto") & (F.col("score") >= plan.fuzzy))
            done.append(reused.select(F.col("q_id").alias("key"), F.col("tgt_text").alias("tgt"), F.lit("fuzzy").alias("origin")))
            suggestions = close.join(reused, "q_id", "left_anti").select("text", "src_text", "tgt_text", "score")
            work = work.join(reused.select(F.col("q_id").alias("key")), "key", "left_anti")
    masked = work.withColumn("m", P.masked(F.col("text"))).select("key", "text", F.col("m.masked").alias("masked"), F.col("m.meant").alias("meant"))
    made = translated(masked, plan.chain, plan.source, plan.target, "masked")
    restored = T.localized_numbers(P.unmasked(F.col("tgt"), F.col("meant")), F.lit(plan.target))
    if plan.glossary:
        restored = P.enforced(restored, plan.glossary)
    fresh = made.where("tgt is not null").withColumn("tgt", T.edge_space(F.col("text"), restored))
    done.append(fresh.select("key", "tgt", F.col("engine").alias("origin")))
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    out = S.scattered(blocks, pieces, "text").drop("key")
    out = out.withColumn("_kind", translatable(F.col("type"), F.col("text")))
    out = out.withColumn("tgt", F.when(F.col("_kind"), F.col("tgt"))).withColumn("origin", F.when(F.col("_kind"), F.col("origin")))
    checked = S.findings(out.withColumn("lang", F.lit(plan.target)), "text", "tgt")
    checked = checked.withColumn("findings", F.when(F.col("_kind"), F.col("findings")).otherwise(F.array().cast(checked.schema["findings"].dataType))).drop("_kind", "lang")
    events = M.puts(fresh.select(F.abs(F.xxhash64("key")).alias("seq"), F.col("text").alias("src"), "tgt"), "seq", plan.target, plan.source, origin="engine")
    return Result(checked, suggestions, events)


def _same(a, b):
    return a.combine(b, lambda x, y: P.same_protected(x or "", y or ""))


def scored(blocks: DataFrame, reference: DataFrame | None = None, by: str = "doc") -> DataFrame:
    """A document's scorecard: its structure, and where there is a reference text (doc, reference) its error rates, and chrF of the output."""
    from papyrion.functions import metrics as X
    from papyrion.operators.scoring import structure

    card = structure(blocks, by)
    if reference is None:
        return card
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(c).alias("t")))), lambda x: x["t"]), "\n")
    texts = blocks.groupBy(by).agg(joined("text").alias("_text")).join(reference, by)
    scores = texts.select(by, F.round(X.error_rate(F.col("reference"), F.col("_text")), 4).alias("cer"), F.round(X.word_error_rate(F.col("reference"), F.col("_text")), 4).alias("wer"), F.round(X.chrf(F.col("reference"), F.col("_text")), 2).alias("chrf"))
    return card.join(scores, by, "left")
