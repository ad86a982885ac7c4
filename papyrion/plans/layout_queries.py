"""Queries over pages of blocks, with boxes derived by arithmetic from keys, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions import geometry as G
from papyrion.functions import text as T
from papyrion.operators import layout as L
from papyrion.plans.tables import table
from papyrion.plans.text_queries import _KEY

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks of pages: a supplier is a document, a line number a page."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    kind = F.when(p % 7 == 0, "figure").when(p % 7 == 1, "caption").when(p % 7 == 2, "table").otherwise("paragraph")
    x0, y0 = (p % 500).cast("double"), (o % 700).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), o.alias("ord"), kind.alias("type"), F.concat(F.col("l_returnflag"), F.lit(" item "), p).alias("text"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_quantity")).alias("x1"), (y0 + 8 + F.col("l_linenumber")).alias("y1"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
    )


_BOXES = """bx AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey AS ord, CASE l_partkey % 7 WHEN 0 THEN 'figure' WHEN 1 THEN 'caption' WHEN 2 THEN 'table' ELSE 'paragraph' END AS type, l_returnflag || ' item ' || l_partkey AS text,
  (l_partkey % 500)::DOUBLE AS x0, (l_orderkey % 700)::DOUBLE AS y0, l_partkey % 500 + 20 + l_quantity AS x1, (l_orderkey % 700 + 8 + l_linenumber)::DOUBLE AS y1 FROM lineitem)"""
_SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"


@query(f"""WITH {_BOXES}, p AS (SELECT a.doc, a.page, a.ord AS a_ord, b.ord AS b_ord, {_SHARED} AS s, {_AREA.format('a')} + {_AREA.format('b')} AS t FROM bx a JOIN bx b ON a.doc = b.doc AND a.page = b.page WHERE a.type = 'paragraph' AND b.type = 'table')
SELECT doc, page, a_ord, b_ord, round(s / (t - s), 6) AS iou FROM p WHERE s > 0""")
def iou_pairs(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return L.iou_pairs(rows.where("type = 'paragraph'"), rows.where("type = 'table'")).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {_BOXES}, p AS (SELECT a.doc, a.page, a.ord, b.ord AS region, {_SHARED} / ({_AREA.format('a')} + {_AREA.format('b')} - {_SHARED}) AS iou FROM bx a JOIN bx b ON a.doc = b.doc AND a.page = b.page WHERE a.type = 'paragraph' AND b.type = 'table' AND {_SHARED} > 0),
m AS (SELECT doc, page, ord, arg_max(region, (iou, -region)) AS region FROM p GROUP BY ALL) SELECT a.doc, a.page, a.ord, m.region FROM bx a LEFT JOIN m USING (doc, page, ord) WHERE a.type = 'paragraph'""")
def best_region(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return L.best_region(rows.where("type = 'paragraph'"), rows.where("type = 'table'")).select("doc", "page", "ord", "region")


@query(f"""WITH {_BOXES}, p AS (SELECT a.doc, a.page, a.ord, b.ord AS media, greatest(0, a.y0 - b.y1, b.y0 - a.y1) AS gap, a.y0 >= b.y0 AS below FROM bx a JOIN bx b ON a.doc = b.doc AND a.page = b.page WHERE a.type = 'caption' AND b.type IN ('figure', 'table') AND least(a.x1, b.x1) > greatest(a.x0, b.x0)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, page, ord ORDER BY gap, media) AS n FROM p) SELECT doc, page, ord, media, gap::DOUBLE AS gap, below FROM r WHERE n = 1""")
def caption_nearest(spark, sf_dir):
    return L.captions(boxes(spark, sf_dir))


@query(f"""WITH {_BOXES} SELECT a.doc, a.page, a.ord FROM bx a WHERE a.type = 'paragraph' AND EXISTS (SELECT 1 FROM bx b WHERE a.doc = b.doc AND a.page = b.page AND b.type = 'figure' AND {_SHARED} > 0.35 * {_AREA.format('a')})""")
def span_over_image(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return L.spans_over_images(rows.where("type = 'paragraph'"), rows.where("type = 'figure'")).select("doc", "page", "ord")


@query(f"""WITH {_BOXES} SELECT a.doc, a.page, a.ord FROM bx a WHERE a.type = 'paragraph' AND NOT EXISTS (SELECT 1 FROM bx b WHERE a.doc = b.doc AND a.page = b.page AND b.type = 'table' AND (((a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)
  OR {_SHARED} >= 0.5 * {_AREA.format('a')} OR ({_SHARED} > 0.1 * {_AREA.format('a')} AND length(a.text) < 40)))""")
def layout_coverage(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return L.uncovered(rows.where("type = 'paragraph'"), rows.where("type = 'table'")).select("doc", "page", "ord")


@query("""WITH e AS (SELECT user_id, event_id, value AS lo, value + 5 AS hi FROM events), r AS (SELECT user_id, lo, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT user_id, lo - reach AS gap, reach FROM r WHERE lo > reach) SELECT user_id, round(max(gap), 6) AS gap, round(arg_max(reach, (gap, -reach)), 6) AS start FROM g GROUP BY user_id""")
def largest_gap(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("lo"), (F.col("value") + 5).alias("hi"))
    return L.largest_gap(spans, ["user_id"], "lo", "hi").select("user_id", F.round("gap", 6).alias("gap"), F.round("start", 6).alias("start"))


@query("""SELECT l.user_id, round(sum(sign(r.value - l.value)) / count(*), 6) AS tau, count(*) AS n_pairs FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_id < r.event_id GROUP BY l.user_id""")
def kendall_tau(spark, sf_dir):
    return L.kendall(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", F.round("tau", 6).alias("tau"), "n_pairs")


def pages_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the pages of one: the first line in the head band, the last in the foot band, the rest between."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"), F.size(F.split("text", "\n", -1)).alias("n"))
    top = F.when(F.col("ord") == 0, 20).when(F.col("ord") == F.col("n") - 1, 760).otherwise(100 + F.col("ord")).cast("double")
    return rows.withColumns({"y0": top, "y1": top + 10, "x0": F.lit(50.0), "x1": F.lit(500.0), "height": F.lit(792.0), "width": F.lit(612.0), "type": F.lit("paragraph")})


_SOURCES = """pg AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
pb AS (SELECT *, CASE WHEN ord = 0 THEN 20 WHEN ord = n - 1 THEN 760 ELSE 100 + ord END AS y0 FROM pg)"""


@query(rf"""WITH {_SOURCES}, k AS (SELECT *, CASE WHEN y0 + 5 < 79.2 THEN 'header' WHEN y0 + 5 > 712.8 THEN 'footer' END AS band, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}_]+|_+', ' ', 'g')) AS key FROM pb),
c AS (SELECT doc, count(DISTINCT page) AS pages FROM pb GROUP BY doc), o AS (SELECT k.doc, band, key FROM k JOIN c ON c.doc = k.doc WHERE band IS NOT NULL AND key <> '' GROUP BY k.doc, band, key, pages HAVING count(DISTINCT page) >= greatest(2, round_even(pages * 0.5, 0)))
SELECT k.doc, k.page, k.ord, CASE WHEN k.band IS NOT NULL AND length(trim(text)) BETWEEN 1 AND 12 AND regexp_matches(trim(text), '(?i)^(page\s+)?\p{{Nd}}+(\s*[/of-]+\s*\p{{Nd}}+)?\.?$') THEN 'page_number' WHEN o.key IS NOT NULL THEN k.band ELSE 'paragraph' END AS type
FROM k LEFT JOIN o ON o.doc = k.doc AND o.band = k.band AND o.key = k.key""")
def running_heads(spark, sf_dir):
    return L.running_heads(pages_of_sources(spark, sf_dir)).select("doc", "page", "ord", "type")


def _dropped(band: str, chars: int, need: str) -> str:
    return rf"""WITH {_SOURCES}, k AS (SELECT *, length(text) <= {chars} AND {band} AS m, regexp_replace({_KEY.format('text')}, '\p{{Nd}}+', '#', 'g') AS key FROM pb), c AS (SELECT doc, count(DISTINCT page) AS pages FROM pb GROUP BY doc),
o AS (SELECT k.doc, key FROM k JOIN c ON c.doc = k.doc WHERE m AND pages >= 3 GROUP BY k.doc, key, pages HAVING count(DISTINCT page) >= greatest(3, {need})) SELECT k.doc, k.page, k.ord FROM k LEFT JOIN o ON o.doc = k.doc AND o.key = k.key WHERE NOT (m AND o.key IS NOT NULL)"""


@query(_dropped("(y0 + 10 <= 0.12 * 792 OR y0 >= 0.88 * 792)", 80, "pages // 2"))
def furniture_drop(spark, sf_dir):
    return L.furniture_dropped(pages_of_sources(spark, sf_dir)).select("doc", "page", "ord")


@query(_dropped("(y0 <= 0.1 * 792 OR y0 + 10 >= 0.9 * 792)", 120, "floor(pages * 0.01)"))
def header_strip(spark, sf_dir):
    rows = pages_of_sources(spark, sf_dir)
    return L.furniture_dropped(rows, band=0.1, chars=120, share=F.floor(F.col("n_pages") * F.lit(0.01)), drop_types=None, touching=True).select("doc", "page", "ord")


@query("""WITH d AS (SELECT conv_id, turn, length(text) AS ro FROM conversations), b AS (SELECT conv_id, lag(ro) OVER (PARTITION BY conv_id ORDER BY turn) > ro AS back FROM d) SELECT conv_id, NOT bool_or(coalesce(back, false)) AS monotonic FROM b GROUP BY conv_id""")
def reading_order_monotonic(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("ro", F.length("text"))
    back = F.lag("ro").over(Window.partitionBy("conv_id").orderBy("turn")) > F.col("ro")
    return rows.withColumn("back", back).groupBy("conv_id").agg((~F.bool_or(F.coalesce("back", F.lit(False)))).alias("monotonic"))


@query(f"WITH {_BOXES} SELECT doc, page, ord, row_number() OVER (PARTITION BY doc ORDER BY page, y0, ord) - 1 AS reading_order FROM bx")
def renumber_order(spark, sf_dir):
    return L.renumbered(boxes(spark, sf_dir).withColumn("reading_order", F.col("y0"))).select("doc", "page", "ord", F.col("reading_order").cast("long").alias("reading_order"))


@query()
def xy_cut(spark, sf_dir):
    return L.reading_order(boxes(spark, sf_dir))


@query()
def greedy_match(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return L.greedy_match(rows.where("type = 'paragraph'"), rows.where("type = 'table'")).withColumn("iou", F.round("iou", 6))


@query()
def column_clusters(spark, sf_dir):
    return L.columns_of(boxes(spark, sf_dir))


@query()
def chain_merge(spark, sf_dir):
    return L.chain_merge(boxes(spark, sf_dir))


@query()
def reflow(spark, sf_dir):
    return L.reflowed(boxes(spark, sf_dir).withColumn("factor", F.lit(1.3)))


@query(f"""WITH {_SOURCES}, r AS (SELECT doc, page, arg_max(text, ord) AS a, arg_min(text, ord) AS b FROM pb GROUP BY doc, page), n AS (SELECT doc, page, regexp_replace(a, '\\s+$', '') AS a, lead(page) OVER w AS p2, regexp_replace(lead(b) OVER w, '^\\s+', '') AS b FROM r WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT doc, page, coalesce(p2 = page + 1 AND CASE WHEN a = '' OR b = '' THEN false WHEN a LIKE '%-' THEN true WHEN regexp_matches(a, '[.!?:;。！？…"''”’)\\]]$') THEN false ELSE regexp_matches(b, '^[\\p{{Ll}}\\p{{Nd}}(,;:]') END, false) AS joins_next FROM n""")
def cross_page(spark, sf_dir):
    return L.across_pages(pages_of_sources(spark, sf_dir).withColumn("reading_order", F.col("ord"))).select("doc", "page", "joins_next")


@query("""WITH s AS (SELECT l_suppkey AS doc, l_quantity::INT AS size, sum(length(l_returnflag || ' item ' || l_partkey)) AS n FROM lineitem GROUP BY ALL) SELECT doc, arg_max(size, (n, -size)) AS size FROM s GROUP BY doc""")
def body_font(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_quantity").cast("int").alias("size"), F.concat(F.col("l_returnflag"), F.lit(" item "), "l_partkey").alias("text"))
    return L.body_font(rows)


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 1000000000000 + round(l_extendedprice * 100)::BIGINT AS pos, l_returnflag AS style, l_linestatus AS text, CASE WHEN l_returnflag = lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000000000 + round(l_extendedprice * 100)::BIGINT) THEN 0 ELSE 1 END AS b FROM lineitem),
r AS (SELECT *, sum(b) OVER (PARTITION BY doc ORDER BY pos) - 1 AS run FROM s) SELECT doc, run::BIGINT AS run, style, string_agg(text, '' ORDER BY pos) AS text FROM r GROUP BY doc, run, style""")
def style_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * F.lit(1000000000000) + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("at"), F.col("l_linestatus").alias("text"), "l_returnflag")
    return L.runs(rows, ["doc"], "at", F.col("l_returnflag")).select("doc", "run", "style", "text")


@query("""WITH p AS (SELECT o_custkey AS doc, (o_orderkey % 40) AS chars, (o_totalprice % 100) / 100 AS cover FROM orders), u AS (SELECT doc, count(*) AS pages, count(*) FILTER (chars > 20 AND NOT ((cover > 0.6 AND chars < 200) OR (cover > 0.35 AND chars < 120))) AS usable FROM p GROUP BY doc)
SELECT doc, usable, pages, CASE WHEN usable = 0 THEN 'scan' WHEN usable = pages THEN 'digital' ELSE 'mixed' END AS kind FROM u""")
def page_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 40).alias("chars"), ((F.col("o_totalprice") % 100) / 100).alias("cover"))
    return L.page_kinds(rows)
