"""Queries over sources, sinks, protected tokens and engines, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.functions import protect as P
from papyrion.functions import text as T
from papyrion.operators import engines as E
from papyrion.sinks import render as R
from papyrion.sources import containers as C
from papyrion.sources import tables as B
from papyrion.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def html_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return C.blocks(pages, "html").select("path", "ord", "type", "text")


@query(r"SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading, len(regexp_extract_all(html, '<h[1-6]>')) AS n_headings, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages")
def html_headings(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("heading"), count("<h[1-6]>").alias("n_headings"), count("<p>").alias("n_paragraphs"))


def _subtitles(spark, sf_dir):
    """Conversations as subtitle files, a turn a cue."""
    turns = table(spark, sf_dir, "conversations")
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n00:00:0"), F.col("turn").cast("string"), F.lit(",000 --> 00:00:09,000\n"), F.regexp_replace("text", "\n+", "\n"))
    return turns.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), R.gathered(F.col("turn"), cue, "\n\n"), F.lit("\n")).alias("text"))


@query(r"""SELECT conv_id, turn + 1 AS n, 'cue' || (turn + 1) AS id, turn || chr(10) || '00:00:0' || turn || ',000 --> 00:00:09,000' AS header, regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'), '^\n+|\n+$', '', 'g') AS body
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, turn, text FROM conversations) WHERE true""")
def subtitle_cues(spark, sf_dir):
    return B.cues(_subtitles(spark, sf_dir), "conv_id").where("is_cue").select("conv_id", F.col("n").cast("long").alias("n"), "id", "header", "body")


@query(r"""SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(turn || chr(10) || '00:00:0' || turn || ',000 --> 00:00:09,000' || chr(10) || '[de] ' || regexp_replace(text, '\n+', chr(10), 'g'), chr(10) || chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id""")
def subtitle_compose(spark, sf_dir):
    cues = B.cues(_subtitles(spark, sf_dir), "conv_id")
    return B.composed(cues, "conv_id", F.concat(F.lit("[de] "), "body"))


@query("""SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '## ' || text WHEN 'user' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY conv_id""")
def markdown_render(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "list_item").otherwise("paragraph")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("type"), F.lit(None).cast("int").alias("level"))
    return R.markdown(rows, "conv_id", "turn")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS s, count(*) FILTER (length(text) < 100) AS short FROM conversations GROUP BY conv_id)
SELECT conv_id, '# Report' || chr(10) || chr(10) || concat_ws(chr(10), CASE WHEN n <> 0 THEN '- turns: ' || n END, CASE WHEN s <> 0 THEN '- system: ' || s END, CASE WHEN short <> 0 THEN '- short: ' || short END) || chr(10) AS report FROM c""")
def report_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "system").alias("s"), F.count_if(F.length("text") < 100).alias("short"))
    return R.report(counts, "conv_id", {"n": "turns", "s": "system", "short": "short"})


@query()
def review_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("id"), F.col("text").alias("src"), T.strip(F.col("text")).alias("tgt"), F.array().cast("array<string>").alias("flags"))
    return R.review(rows, "conv_id", "turn")


@query("SELECT doc_id, text, true AS masked_all FROM documents")
def protect_roundtrip(spark, sf_dir):
    """Texts with their protected tokens masked and put back; no address is left in between."""
    rows = table(spark, sf_dir, "documents").select("doc_id", P.masked(F.col("text")).alias("m"))
    return rows.select("doc_id", P.unmasked(F.col("m.masked"), F.col("m.meant")).alias("text"), (~F.col("m.masked").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]{2}")).alias("masked_all"))


@query()
def glossary_enforce(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.enforced(F.col("text"), {"the": "die", "that the": "dass die", "and": "und"}).alias("text"))


@query("SELECT conv_id, turn, '[de] ' || text AS tgt, 'echo' AS engine FROM conversations")
def engine_chain(spark, sf_dir):
    """A chain whose first engine isn't there; the echo engine takes what it leaves."""
    work = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return E.translated(work, [("nllb", E.ENGINES["nllb"]), ("echo", E.echo)], "en", "de").select("conv_id", "turn", "tgt", "engine")


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Cyrillic}\p{Arabic}\p{Devanagari}\p{Bengali}\p{Thai}\p{Hebrew}\p{Greek}]+'))) AS n FROM documents")
def residual_scripts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(E.residual(F.col("text"))).cast("long").alias("n"))
