"""Queries over document rules, styles, reports, stores and whole-document translation, with the SQL they are checked against."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import geometry as G
from papyrion.functions import protect as V
from papyrion.functions import text as T
from papyrion.operators import alignment as A
from papyrion.operators import documents as D
from papyrion.operators import engines as E
from papyrion.operators import layout as L
from papyrion.operators import memory as M
from papyrion.operators import pages as P
from papyrion.operators import scoring as C
from papyrion.operators import segments as S
from papyrion.operators import translate as X
from papyrion.plans.layout_queries import _BOXES, boxes
from papyrion.plans.memory_queries import _EVENTS, tm_events
from papyrion.plans.tables import table
from papyrion.plans.text_queries import _FOUND, _KEY, _LINES, _STRIP, _TURN_PAIRS, turn_pairs
from papyrion.sinks import archives, render
from papyrion.sources import containers as K
from papyrion.sources import tables as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_ITEM = "l_orderkey, l_linenumber"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


_NUMBERED = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item for each number of an order, as some come twice."""
    return items(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")))


@query(f"""SELECT {_ITEM}, k NOT IN ('code', 'formula', 'page_number', 'stamp', 'signature', 'figure') AND l_quantity > 5 AS translatable, l_partkey >= 2000 AND l_quantity < 100 AS outline, k NOT IN ('formula', 'formula_number') OR l_quantity >= 50 OR l_linenumber * 5 >= 20 AS crop,
  l_discount * 10 < 0.5 AS unreliable, l_linenumber = 1 OR l_discount * 10 < 0.6 OR l_tax > 0.25 AS stronger, l_partkey > 5000 AS pages_over, l_partkey * l_suppkey * 10 > 300000000 AS pixels_over,
  l_quantity < 40 AND l_linenumber * 40 > 4 * l_quantity AS upright, l_partkey & 16 <> 0 AS bold, l_partkey & 2 <> 0 AS italic, CASE WHEN l_returnflag = 'A' THEN 'flow' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'reconstruct' ELSE 'flow' END AS fidelity
FROM (SELECT *, CASE l_partkey % 5 WHEN 0 THEN 'formula' WHEN 1 THEN 'figure' WHEN 2 THEN 'code' ELSE 'paragraph' END AS k FROM lineitem)""")
def block_rules(spark, sf_dir):
    """F10, F51, F57, F58, F60, P16, S43, S45, Y13, Y19 on line items as blocks."""
    p, q, n = F.col("l_partkey"), F.col("l_quantity"), F.col("l_linenumber")
    kind = F.when(p % 5 == 0, "formula").when(p % 5 == 1, "figure").when(p % 5 == 2, "code").otherwise("paragraph")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), q.cast("double").alias("x1"), (n * 40).cast("double").alias("y1"))
    style = P.flags_style(p)
    asked = F.when(F.col("l_returnflag") == "A", "flow").otherwise("auto")
    return items(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", D.translatable(kind, F.when(q > 5, "text").otherwise(" \t")).alias("translatable"), P.outline_page(p, q).alias("outline"), D.crop_worthy(kind, q, n * 5).alias("crop"), D.unreliable(F.col("l_discount") * 10).alias("unreliable"),
        D.needs_stronger(n - 1, F.col("l_discount") * 10, F.col("l_tax")).alias("stronger"), D.too_many_pages(p).alias("pages_over"), D.too_many_pixels(p, F.col("l_suppkey") * 10).alias("pixels_over"), G.vertical(box).alias("upright"), style["bold"].alias("bold"), style["italic"].alias("italic"),
        D.fidelity(asked, F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "N", "pdf").otherwise("docx")).alias("fidelity"),
    )


@query(rf"""SELECT doc_id, regexp_replace(text, '([a-zà-öø-ÿ])-\s+([a-zà-öø-ÿ])', '\1\2', 'g') AS stitched, regexp_matches(text, '[\p{{Hebrew}}\p{{Arabic}}\p{{Syriac}}\p{{Thaana}}\p{{Nko}}]') AND regexp_matches(text, '\p{{Latin}}') AS mixed,
  len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda w: w IN ('the', 'and', 'der', 'que'))) AS n_markers,
  CASE WHEN lang IN ('de', 'fr', 'es') THEN 'Latin' ELSE 'Latin' END AS script FROM documents""")
def text_rules(spark, sf_dir):
    """F8, F28, F45, F48."""
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.dehyphenated(x).alias("stitched"), T.mixed_direction(x).alias("mixed"), T.marker_count(x, ["the", "and", "der", "que"]).alias("n_markers"), T.script_of_language(F.col("lang")).alias("script"))


_ADJ = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'goes on to ' || c_mktsegment WHEN 1 THEN 'ends here. ' WHEN 2 THEN 'a hyphen-' ELSE '  open (' END AS a, CASE c_custkey % 3 WHEN 0 THEN ' next part' WHEN 1 THEN 'Next Part ' ELSE '7 parts' END AS b FROM customer"


@query(rf"""WITH p AS ({_ADJ}), q AS (SELECT id, a, b, regexp_replace(a, '\s+$', '') AS x, regexp_replace(b, '^\s+', '') AS y FROM p)
SELECT id, CASE WHEN x LIKE '%-' THEN true WHEN regexp_matches(x, '[.!?:;。！？…"''”’)\]]$') THEN false ELSE regexp_matches(y, '^[\p{{Ll}}\p{{Nd}}(,;:]') END AS goes_on,
  CASE WHEN regexp_matches(x, '\p{{Ll}}-$') AND regexp_matches(y, '^\p{{Ll}}') THEN regexp_replace(x, '-$', '') || y ELSE x || ' ' || y END AS joined,
  regexp_extract(a, '^\s*') || {_STRIP.format('b')} || regexp_extract(a, '\s*$') AS edged, array_to_string([regexp_split_to_array(trim(y), '\s+')[1 + i % len(regexp_split_to_array(trim(y), '\s+'))] FOR i IN range(ceil(1.5 * len(regexp_split_to_array(trim(y), '\s+')))::BIGINT)], ' ') AS longer FROM q""")
def paragraph_edges(spark, sf_dir):
    """F33, F49, F55, F56 on made-up neighbours."""
    k = F.col("c_custkey")
    a = F.when(k % 4 == 0, F.concat(F.lit("goes on to "), "c_mktsegment")).when(k % 4 == 1, "ends here. ").when(k % 4 == 2, "a hyphen-").otherwise("  open (")
    b = F.when(k % 3 == 0, " next part").when(k % 3 == 1, "Next Part ").otherwise("7 parts")
    return table(spark, sf_dir, "customer").select(k.alias("id"), T.continues(a, b).alias("goes_on"), T.joined(a, b).alias("joined"), T.edge_space(a, b).alias("edged"), T.expanded(b, 1.5).alias("longer"))


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> '') AS parts FROM documents),
r AS (SELECT doc_id, unnest(range(len(parts))) AS ord, unnest(parts) AS part FROM p) SELECT doc_id, ord, CASE WHEN part LIKE '#%' THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN part LIKE '#%' THEN {_STRIP.format("regexp_replace(part, '^#+', '')")} ELSE part END AS text FROM r""")
def text_paragraphs(spark, sf_dir):
    return S.paragraphs(table(spark, sf_dir, "documents"))


@query("""WITH s AS (SELECT l_suppkey AS doc, l_orderkey AS ord, 8 + l_partkey % 9 AS size, l_partkey % 11 = 0 AS bold, CASE WHEN l_linenumber = 1 THEN '2.1 Results ' || l_partkey ELSE l_returnflag || ' item ' || l_partkey || repeat('x', (l_quantity * 3)::INT) END AS text FROM lineitem),
n AS (SELECT doc, size, sum(length(text)) AS n FROM s GROUP BY ALL), b AS (SELECT doc, arg_max(size, (n, -size)) AS body FROM n GROUP BY doc)
SELECT s.doc, s.ord, s.text, CASE WHEN size / body >= 1.6 THEN 'title' WHEN size / body >= 1.2 OR ((bold OR (text LIKE '2.1 Results%')) AND length(text) <= 80) THEN 'heading' ELSE 'paragraph' END AS type FROM s JOIN b ON b.doc = s.doc""")
def font_types(spark, sf_dir):
    """F13, F16."""
    p = F.col("l_partkey")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("2.1 Results "), p)).otherwise(F.concat("l_returnflag", F.lit(" item "), p, F.repeat(F.lit("x"), (F.col("l_quantity") * 3).cast("int"))))
    spans = items(spark, sf_dir).select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("ord"), (8 + p % 9).alias("size"), (p % 11 == 0).alias("bold"), text.alias("text"))
    return L.typed(spans, L.body_font(spans)).select("doc", "ord", "text", "type")


@query(f"""WITH {_NUMBERED}, l AS (SELECT l_orderkey AS blk, l_linenumber AS n, l_linenumber * 12 + l_partkey % 5 AS y1, 8 + l_linenumber % 2 AS size FROM li), g AS (SELECT blk, (y1 - lag(y1) OVER (PARTITION BY blk ORDER BY n)) / size AS gap FROM l), m AS (SELECT blk, median(gap) AS s FROM g GROUP BY blk)
SELECT blk, round(CASE WHEN s BETWEEN 0.9 AND 3.0 THEN s END, 6) AS spacing FROM m""")
def line_spacing(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = numbered(spark, sf_dir).select(F.col("l_orderkey").alias("blk"), n.alias("n"), (n * 12 + F.col("l_partkey") % 5).alias("y1"), (8 + n % 2).alias("size"))
    return P.line_spacing(rows, ["blk"], "n").select("blk", F.round("spacing", 6).alias("spacing"))


@query(f"""WITH {_NUMBERED}, g AS (SELECT l_orderkey AS line, l_linenumber AS n, l_returnflag AS c, l_linenumber * 10 + l_partkey % 4 AS x0, l_linenumber * 10 + l_partkey % 4 + 6 + l_suppkey % 3 AS x1 FROM li),
w AS (SELECT *, median(x1 - x0) OVER (PARTITION BY line) AS m, lag(x1) OVER (PARTITION BY line ORDER BY n) AS before FROM g), t AS (SELECT line, string_agg(CASE WHEN coalesce(x0 - before > 0.4 * m, false) THEN ' ' ELSE '' END || c, '' ORDER BY n) AS text, string_agg(c, '' ORDER BY n) AS bare FROM w GROUP BY line)
SELECT line, text, CASE WHEN contains(text, ' ') THEN text ELSE bare END AS adopted FROM t""")
def glyph_spacing(spark, sf_dir):
    """F19, F20, Y3."""
    n, x0 = F.col("l_linenumber"), F.col("l_linenumber") * 10 + F.col("l_partkey") % 4
    glyphs = numbered(spark, sf_dir).select(F.col("l_orderkey").alias("line"), n.alias("n"), F.col("l_returnflag").alias("char"), x0.alias("x0"), (x0 + 6 + F.col("l_suppkey") % 3).alias("x1"))
    out = P.respaced(glyphs, ["line"], "n")
    return out.select("line", "text", P.spacing_adopted(F.replace("text", F.lit(" "), F.lit("")), F.col("text")).alias("adopted"))


@query(f"""WITH {_NUMBERED}, l AS (SELECT l_orderkey AS blk, l_linenumber AS n, 6 + l_partkey % 9 AS size FROM li), j AS (SELECT *, lag(size) OVER w AS b FROM l WINDOW w AS (PARTITION BY blk ORDER BY n))
SELECT blk, n, sum(CASE WHEN size >= 1.6 * b OR b >= 1.6 * size THEN 1 ELSE 0 END) OVER (PARTITION BY blk ORDER BY n)::BIGINT AS part FROM j""")
def size_jumps(spark, sf_dir):
    rows = numbered(spark, sf_dir).select(F.col("l_orderkey").alias("blk"), F.col("l_linenumber").alias("n"), (6 + F.col("l_partkey") % 9).alias("size"))
    return L.split_at_size(rows, ["blk"], "n").select("blk", "n", "part")


@query(f"""WITH {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, y0, x0, ord, text) - 1 AS reading_order FROM bx) SELECT doc, page, ord, text, row_number() OVER (PARTITION BY doc ORDER BY page, (x1 - x0 < 40 AND y1 - y0 > 0.5 * (x1 - x0)), reading_order, ord) - 1 AS place FROM
  (SELECT * REPLACE (y0 + (y1 - y0) AS y1) FROM r)""")
def upright_last(spark, sf_dir):
    """W6 with boxes eight times as high, so that some are upright."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("page", "y0", "x0", "ord", "text")
    rows = boxes(spark, sf_dir).withColumn("reading_order", F.row_number().over(w) - 1).withColumn("y1", F.col("y0") + 8 * (F.col("y1") - F.col("y0")))
    return L.vertical_last(rows).select("doc", "page", "ord", "text", F.col("reading_order").cast("long").alias("place"))


@query(f"""WITH {_BOXES} SELECT doc, count(*) >= 6 AND count(*) FILTER (x1 <= 0.55 * 612) >= 3 AND count(*) FILTER (x0 >= 0.45 * 612) >= 3 AS two FROM bx WHERE page = 1 GROUP BY doc""")
def two_column_guess(spark, sf_dir):
    return P.guessed_columns(boxes(spark, sf_dir).withColumn("page", F.col("page") - 1))


@query("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS ord, l_linenumber AS reading_order, CASE WHEN l_linenumber % 3 = 0 THEN (l_linenumber + 2) % 5 + 1 END AS anchor FROM lineitem),
k AS (SELECT b.doc, b.ord, coalesce(a.reading_order + 0.5, b.reading_order) AS key FROM b LEFT JOIN b a ON a.doc = b.doc AND a.ord = b.anchor) SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY key, ord) - 1 AS place FROM k""")
def caption_resnap(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), n.alias("ord"), n.alias("reading_order"), F.when(n % 3 == 0, (n + 2) % 5 + 1).alias("anchor"))
    return P.resnapped(rows).select("doc", "ord", F.col("reading_order").cast("long").alias("place"))


@query("""WITH d AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey AS ord, l_quantity * 12 AS w, l_partkey % 800 AS h, CASE WHEN l_partkey % 3 = 0 THEN '#ffffff' ELSE '#' || l_returnflag END AS fill FROM lineitem)
SELECT doc, page, count(*) FILTER (greatest(w, h) >= 3 AND NOT (w >= 0.95 * 612 AND h >= 0.95 * 792)) AS n_art, arg_max(fill, ord) FILTER (w >= 0.95 * 612 AND h >= 0.95 * 792 AND fill <> '#ffffff') AS fill FROM d GROUP BY ALL""")
def page_drawings(spark, sf_dir):
    """S29, S30."""
    p = F.col("l_partkey")
    rows = items(spark, sf_dir).select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("ord"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") * 12).cast("double").alias("x1"), (p % 800).cast("double").alias("y1"),
        F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.when(p % 3 == 0, "#ffffff").otherwise(F.concat(F.lit("#"), "l_returnflag")).alias("fill"))
    art = P.line_art(rows).groupBy("doc", "page").agg(F.count("*").alias("n_art"))
    pages = rows.select("doc", "page").distinct()
    return pages.join(art, ["doc", "page"], "left").na.fill(0, ["n_art"]).join(P.background(rows), ["doc", "page"], "left")


@query("""SELECT c_custkey AS id, round(CASE WHEN m <= 0.05 * 600 AND l > 60 THEN 1 WHEN 600 - r <= 60 AND l > 240 THEN 2 ELSE 0 END)::INT AS kind, least(l, l + 30) AS x0, greatest(r, l + 30) AS x1 FROM (SELECT c_custkey, c_custkey % 300 AS l, 300 + (c_custkey * 7) % 301 AS r, abs(c_custkey % 300 - (600 - (300 + (c_custkey * 7) % 301))) AS m FROM customer)""")
def block_alignment(spark, sf_dir):
    """F14, F62, S31."""
    k = F.col("c_custkey")
    l, r = k % 300, 300 + (k * 7) % 301
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    quad = P.quads(F.array(point(l, k), point(r, k), point(l + 30, k + 5), point(l, k + 5)))[0]
    kind = P.alignment(l, r, F.lit(600), F.lit(True))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.when(kind == "center", 1).when(kind == "right", 2).otherwise(0).alias("kind"), quad["x0"].cast("long").alias("x0"), quad["x1"].cast("long").alias("x1"))


@query("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_returnflag || l_partkey AS t, l_partkey % 2 = 0 AS b, l_partkey % 3 = 0 AS i, l_partkey % 7 = 0 AS s FROM lineitem)
SELECT doc, n, CASE WHEN i THEN '*' ELSE '' END || CASE WHEN b THEN '**' ELSE '' END || CASE WHEN s THEN '<sup>' || t || '</sup>' ELSE t END || CASE WHEN b THEN '**' ELSE '' END || CASE WHEN i THEN '*' ELSE '' END AS markdown,
  CASE WHEN b OR i THEN '<span style="' || concat_ws(';', CASE WHEN b THEN 'font-weight:bold' END, CASE WHEN i THEN 'font-style:italic' END) || '">' || t || '</span>' ELSE t END AS html,
  '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || t || ' | x\\| |' AS md_table, '<table><tr><td>a</td><td>b</td></tr><tr><td>' || t || '</td><td>&lt;</td></tr></table>' AS html_table FROM r""")
def run_markup(spark, sf_dir):
    """K3 to K7."""
    p, t = F.col("l_partkey"), F.concat("l_returnflag", "l_partkey")
    off, none = F.lit(False), F.lit(None).cast("string")
    style = F.struct((p % 2 == 0).alias("bold"), (p % 3 == 0).alias("italic"), (p % 7 == 0).alias("sup"), *(off.alias(n) for n in ("sub", "strike", "underline", "caps", "highlight")), none.alias("link"), none.alias("size"), none.alias("color"))
    grid = lambda last: F.array(F.array(F.lit("a"), F.lit("b")), F.array(t, F.lit(last)))
    return items(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), render.run_markdown(t, style).alias("markdown"), render.styled(t, style).alias("html"), render.table_markdown(grid("x|")).alias("md_table"), render.table_html(grid("<")).alias("html_table"))


@query("""SELECT p_partkey, regexp_replace(p_brand || '/x.v1.pdf', '\\.[^./]+$', '') || '.de.docx' AS name, '<tu><tuv xml:lang="en"><seg>' || p_name || ' &lt;&amp;&gt;</seg></tuv><tuv xml:lang="de"><seg>' || p_type || '</seg></tuv></tu>' AS unit FROM part""")
def output_names(spark, sf_dir):
    """K30, K35, Y38."""
    return table(spark, sf_dir, "part").select("p_partkey", render.output_name(F.concat("p_brand", F.lit("/x.v1.pdf")), F.lit("docx"), F.lit("de")).alias("name"), B.unit_markup(F.concat("p_name", F.lit(" <&>")), F.col("p_type"), "en", "de").alias("unit"))


@query("""WITH e AS (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderkey % 12 AS page FROM orders), p AS (SELECT DISTINCT o_custkey AS doc, o_orderkey % 8 AS page, (o_orderkey % 8) * 2 AS out_page FROM orders), n AS (SELECT doc, max(out_page) AS last FROM p GROUP BY doc)
SELECT e.doc, e.ord, greatest(0, least(p.out_page, n.last)) AS out_page FROM e JOIN p ON p.doc = e.doc AND p.page = e.page JOIN n ON n.doc = e.doc""")
def outline_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"))
    pages = o.select("doc", (F.col("ord") % 8).alias("page"), ((F.col("ord") % 8) * 2).alias("out_page")).distinct()
    return P.outline(o.withColumn("page", F.col("ord") % 12), pages).select("doc", "ord", "out_page")


@query("""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, 0.7 + l_discount * 3 AS s, l_tax < 0.05 AS same FROM lineitem) SELECT id, n, CASE WHEN s >= 0.95 AND same THEN 'auto' WHEN s >= 0.75 THEN 'suggest' END AS tier FROM c""")
def reuse_tiers(spark, sf_dir):
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (0.7 + F.col("l_discount") * 3).alias("score"), (F.col("l_tax") < 0.05).alias("same_tokens"))
    return M.reuse(rows).select("id", "n", "tier")


@query("""WITH s AS (SELECT conv_id AS doc_id, turn AS ord, text AS source, '[de] ' || text AS translation FROM conversations), e AS (SELECT conv_id AS doc_id, turn AS ord, CASE WHEN turn % 2 = 0 THEN '[de] ' || text WHEN turn % 5 = 0 THEN ' ' ELSE upper(role) || ' mended' END AS line FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 0)),
ok AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS m FROM e GROUP BY ALL) USING (doc_id) WHERE n = m)
SELECT s.doc_id, s.ord, e.line AS correction FROM s JOIN e USING (doc_id, ord) WHERE s.doc_id IN (FROM ok) AND trim(e.line) <> '' AND e.line <> s.translation""")
def review_corrections(spark, sf_dir):
    """J18, M14, M15."""
    turns = table(spark, sf_dir, "conversations")
    sidecar = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("text").alias("source"), S.echo(F.col("text"), "de").alias("translation"))
    line = F.when(F.col("turn") % 2 == 0, S.echo(F.col("text"), "de")).when(F.col("turn") % 5 == 0, " ").otherwise(F.concat(F.upper("role"), F.lit(" mended")))
    edited = turns.where(~((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0))).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), line.alias("line"))
    aligned = M.aligned_review(edited, sidecar).withColumn("scope", F.lit("segment"))
    return M.corrections(aligned, "ord", "de")[0].select("doc_id", "ord", "correction")


@query("""WITH e AS (SELECT p_type AS term, p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN 'remove' ELSE 'add' END AS kind, p_brand AS rendering, p_size % 7 = 0 AS locked FROM part), l AS (SELECT term, arg_max(kind, seq) AS kind, arg_max(rendering, seq) AS rendering, arg_max(locked, seq) AS locked FROM e GROUP BY term)
SELECT term, rendering, locked FROM l WHERE kind = 'add' AND NOT locked""")
def glossary_events(spark, sf_dir):
    """M8 to M10, Y41."""
    part = table(spark, sf_dir, "part")
    events = part.select(F.col("p_type").alias("term"), *(F.lit("").alias(c) for c in ("src_lang", "tgt_lang", "domain")), F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 5 == 0, "remove").otherwise("add").alias("kind"), F.col("p_brand").alias("rendering"), F.lit("user").alias("origin"), (F.col("p_size") % 7 == 0).alias("locked"))
    return M.listed(M.glossary_view(events), src_lang=None, domain="", locked=False).select("term", "rendering", "locked")


@query("""WITH k AS (SELECT DISTINCT p_type AS term FROM part WHERE p_size < 10), n AS (SELECT p_type AS term, arg_min(p_brand, p_partkey) AS rendering FROM part GROUP BY p_type), q AS (SELECT k.term, 'known' AS rendering FROM k UNION ALL SELECT term, rendering FROM n WHERE term NOT IN (FROM k))
SELECT term, rendering, term LIKE 'STANDARD%' AS accepted FROM q""")
def glossary_suggestions(spark, sf_dir):
    """M11 to M13."""
    part = table(spark, sf_dir, "part")
    known = part.where("p_size < 10").select(F.col("p_type").alias("term"), F.lit("known").alias("rendering"), F.lit(0).cast("long").alias("seq")).distinct()
    queue = M.suggested(known, part.select(F.col("p_type").alias("term"), F.col("p_brand").alias("rendering"), F.col("p_partkey").cast("long").alias("seq")))
    taken, left = M.accepted(queue, queue.where(F.col("term").startswith("STANDARD")))
    return taken.select("term", "rendering", F.lit(True).alias("accepted")).unionByName(M.listed(left).select("term", "rendering", F.lit(False).alias("accepted")))


@query("""SELECT o_orderkey AS job_id, o_custkey AS batch FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' - INTERVAL 24 HOURS AND o_custkey = 7""")
def batch_jobs(spark, sf_dir):
    """The jobs of a batch that are not too old, by update."""
    orders = table(spark, sf_dir, "orders")
    events = orders.select(F.col("o_orderkey").alias("job_id"), F.lit(1).alias("seq"), F.col("o_custkey").alias("batch_id"), F.lit("done").alias("status"), F.lit("").alias("error"), F.col("o_orderdate").alias("updated"))
    return D.batch_jobs(M.evicted(M.jobs(events), F.expr("TIMESTAMP_NTZ '1997-06-01 00:00:00'")), 7).select("job_id", F.col("batch_id").alias("batch"))


@query("""SELECT c_nationkey::VARCHAR AS tgt_lang, lower(c_name) AS norm, c_mktsegment AS tgt_text FROM customer WHERE c_custkey % 4 <> 0""")
def legacy_memory(spark, sf_dir):
    k = F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit("\u0000"), F.lower("c_name")))
    return M.legacy_import(table(spark, sf_dir, "customer").select(k.alias("key"), F.col("c_mktsegment").alias("value")))


_SPANS = "s AS (SELECT l_suppkey AS doc, CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE l_returnflag || l_partkey END AS text, round(8 + (l_partkey % 5) / 4, 1) AS size, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Serif' ELSE 'Mono' END AS font, l_partkey % 4 AS color, l_partkey % 32 AS flags, l_linestatus FROM lineitem)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    return items(spark, sf_dir).select(F.col("l_suppkey").alias("doc"), F.when(p % 13 == 0, " ").otherwise(F.concat("l_returnflag", p)).alias("text"), F.round(8 + (p % 5) / 4, 1).alias("size"), F.when(p % 3 == 0, "").when(p % 3 == 1, "Serif").otherwise("Mono").alias("font"), (p % 4).alias("color"), (p % 32).alias("flags"), "l_linestatus")


@query(f"""WITH {_SPANS}, n AS (SELECT doc, length(text) AS k, size, CASE font WHEN '' THEN 'sans-serif' ELSE font END AS font, color, flags FROM s WHERE text <> ' '),
a AS (SELECT doc, arg_max(size, (k, -size)) AS size FROM (SELECT doc, size, sum(k) AS k FROM n GROUP BY ALL) GROUP BY doc), c AS (SELECT doc, arg_max(color, (k, -color)) AS color FROM (SELECT doc, color, sum(k) AS k FROM n GROUP BY ALL) GROUP BY doc),
f AS (SELECT doc, min(font) AS font FROM (SELECT *, rank() OVER (PARTITION BY doc ORDER BY k DESC) AS r FROM (SELECT doc, font, sum(k) AS k FROM n GROUP BY ALL)) WHERE r = 1 GROUP BY doc),
b AS (SELECT doc, 2 * sum(CASE WHEN flags & 16 <> 0 THEN k ELSE 0 END) > sum(k) AS bold, 2 * sum(CASE WHEN flags & 2 <> 0 THEN k ELSE 0 END) > sum(k) AS italic FROM n GROUP BY doc) SELECT doc, size, font, color, bold, italic FROM a JOIN c USING (doc) JOIN f USING (doc) JOIN b USING (doc)""")
def region_style(spark, sf_dir):
    return D.region_style(spans(spark, sf_dir), "doc")


@query(f"""WITH {_SPANS}, o AS (SELECT doc, l_linestatus AS st, count(*) AS spans, count(*) FILTER (flags & 16 <> 0) AS bold, count(*) FILTER (flags & 2 <> 0) AS italic, count(*) FILTER (color <> 0) AS colored FROM s WHERE text <> ' ' GROUP BY ALL),
u AS (UNPIVOT o ON spans, bold, italic, colored INTO NAME feature VALUE n), j AS (SELECT a.doc, a.feature, a.n AS before, coalesce(b.n, 0) AS after FROM u a LEFT JOIN u b ON b.doc = a.doc AND b.feature = a.feature AND b.st = 'F' WHERE a.st = 'O')
SELECT doc, feature, before, after, CASE WHEN feature = 'spans' OR before = 0 THEN '' WHEN after / before > 1.5 THEN 'over-applied' WHEN after / before < 0.4 THEN 'mostly lost' ELSE 'carried' END AS note FROM j""")
def features_compared(spark, sf_dir):
    rows = spans(spark, sf_dir)
    one = lambda s: D.page_features(rows.where(F.col("l_linestatus") == s), "doc")
    return D.features_compared(one("O"), one("F"))


@query("""WITH p AS (SELECT l_suppkey AS doc, l_orderkey AS page, CASE WHEN l_partkey % 40 = 0 THEN 1 ELSE 0 END AS images, l_partkey % 53 = 0 AS two FROM lineitem) SELECT doc, NOT bool_or(images > 0 OR two) AS simple FROM p GROUP BY doc""")
def simple_documents(spark, sf_dir):
    p = F.col("l_partkey")
    return D.simple_digital(items(spark, sf_dir).select(F.col("l_suppkey").alias("doc"), F.when(p % 40 == 0, 1).otherwise(0).alias("images"), (p % 53 == 0).alias("two")))


@query(_FOUND + """ SELECT DISTINCT conv_id AS doc, turn AS ord FROM y UNION SELECT conv_id, turn FROM p WHERE turn % 4 = 1""")
def weak_blocks(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    found = S.findings(pairs).select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.inline("findings"))
    low = F.when(F.col("turn") % 4 == 1, F.array(F.lit("low_translation_quality"))).otherwise(F.array().cast("array<string>"))
    return D.weak_blocks(found, pairs.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), low.alias("flags")))


@query("""SELECT c_custkey AS id, CASE WHEN new = '' OR new = trim(old) OR length(new) > 1.5 * length(old) + 10 THEN old ELSE new END AS text, c_custkey % 2 = 0 AND length(old) >= 8 AS asked FROM (SELECT c_custkey, c_mktsegment AS old, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' WHEN 2 THEN c_mktsegment || repeat('x', c_custkey % 40) ELSE lower(c_mktsegment) END AS new FROM customer)""")
def ocr_repairs(spark, sf_dir):
    """P15."""
    k, old = F.col("c_custkey"), F.col("c_mktsegment")
    new = F.when(k % 4 == 0, old).when(k % 4 == 1, "").when(k % 4 == 2, F.concat(old, F.repeat(F.lit("x"), (k % 40).cast("int")))).otherwise(F.lower(old))
    flags = F.when(k % 2 == 0, F.array(F.lit("low_ocr_confidence"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), D.repaired(old, new).alias("text"), D.repairable(flags, old).alias("asked"))


@query("""WITH s AS (SELECT l_suppkey AS doc, l_returnflag AS engine, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS place, CASE WHEN l_linenumber > 1 THEN l_quantity END AS score FROM lineitem),
m AS (SELECT doc, engine, round(avg(score), 4) AS mean, min(place) AS place FROM s WHERE score IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) SELECT doc, arg_max(engine, (mean, -place)) AS engine, max(mean) AS mean FROM m GROUP BY doc""")
def engine_choice(spark, sf_dir):
    """A24."""
    place = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = items(spark, sf_dir).select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("engine"), place.alias("place"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("score"))
    return D.best_engine(rows)


@query("""WITH b AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations WHERE role <> 'system' AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 20) SELECT conv_id AS doc, turn AS ord, r AS rank FROM b WHERE r <= 12""")
def engine_sample(spark, sf_dir):
    """The blocks that engines are compared on."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.when(F.col("role") == "system", "code").otherwise("paragraph").alias("type"), "text")
    return D.sampled(rows).select("doc", "ord", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH p AS ({_TURN_PAIRS}), q AS (SELECT conv_id, turn, CASE WHEN length(src) > 0 AND length(tgt) > 0 THEN least(length(src), length(tgt)) / greatest(length(src), length(tgt)) END AS s FROM p)
SELECT conv_id, count(s) AS n, round(avg(round(s, 3)), 6) AS mean, min(round(s, 3)) AS lowest, count(*) FILTER (round(s, 3) < 0.75) AS below, count(*) FILTER (s < 0.75) AS flagged FROM q GROUP BY conv_id""")
def quality_stats(spark, sf_dir):
    """A25, Y66 with a score by length."""
    pairs = turn_pairs(spark, sf_dir).withColumn("flags", F.array().cast("array<string>"))
    a, b = F.length("src"), F.length("tgt")
    scored = D.quality_annotated(pairs, F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)))
    out = D.quality_stats(scored, "conv_id")
    return out.withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT p_brand AS term, p_type AS tgt FROM part), t AS (SELECT DISTINCT p_brand AS term, CASE WHEN p_brand LIKE '%1' THEN ' ' ELSE 'Brass' END AS rendering FROM part) SELECT term, round(avg((trim(rendering) = '' OR contains(lower(tgt), 'brass'))::INT), 6) AS share, count(*) AS n FROM c JOIN t USING (term) GROUP BY term""")
def term_consistency(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.select(F.col("p_brand").alias("term")).distinct().withColumn("rendering", F.when(F.col("term").endswith("1"), " ").otherwise("Brass"))
    return D.term_consistency(part.select(F.col("p_brand").alias("term"), F.col("p_type").alias("tgt")), terms).withColumn("share", F.round("share", 6))


@query(_FOUND + """ SELECT 'de' AS lang, chk <> 'length' AS hard, chk AS "check", count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS rate FROM y GROUP BY chk""")
def checks_by_language(spark, sf_dir):
    return D.checked_by_language(S.findings(turn_pairs(spark, sf_dir))).withColumn("rate", F.round("rate", 6))


@query("""SELECT n_regionkey AS doc, '## Terms found in this run' || chr(10) || string_agg('- `' || n_name || '` → `' || lower(n_name) || '`', chr(10) ORDER BY n_nationkey) AS section, '## Close past translations' || chr(10) || string_agg('- (' || (75 + n_nationkey % 20) || '%) `' || n_name || '`' || chr(10) || '  - before: `a` → `b`', chr(10) ORDER BY n_nationkey) AS close FROM nation GROUP BY n_regionkey""")
def report_sections(spark, sf_dir):
    """Y37, C2."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("term"), F.lower("n_name").alias("rendering"), ((75.5 + F.col("n_nationkey") % 20) / 100).alias("score"), F.col("n_name").alias("src"), F.lit("a").alias("past_src"), F.lit("b").alias("past_tgt"))
    return D.suggestion_report(rows).join(D.fuzzy_report(rows).withColumnRenamed("section", "close"), "doc")


@query("""WITH s AS (SELECT r_name AS lang, length(r_name) * 10 + 0.5 AS a, CASE WHEN r_regionkey <> 2 THEN 65.0 END AS b FROM region), w AS (SELECT *, CASE WHEN a >= coalesce(b, -1) THEN 'a' ELSE 'b' END AS win FROM s)
SELECT '| lang | a | b |' || chr(10) || '|---|---:|---:|' || chr(10) || string_agg('| ' || lang || ' | ' || CASE WHEN win = 'a' THEN '**' || printf('%.1f', a) || '**' ELSE printf('%.1f', a) END || ' | ' || CASE WHEN b IS NULL THEN '-' WHEN win = 'b' THEN '**' || printf('%.1f', b) || '**' ELSE printf('%.1f', b) END || ' |', chr(10) ORDER BY lang) || chr(10) || chr(10) || 'won: a: ' || count(*) FILTER (win = 'a') || ', b: ' || count(*) FILTER (win = 'b') AS markdown FROM w""")
def score_table(spark, sf_dir):
    """Y56."""
    rows = table(spark, sf_dir, "region")
    a = rows.select(F.col("r_name").alias("lang"), F.lit("a").alias("engine"), (F.length("r_name") * 10 + F.lit(0.5).cast("double")).alias("score"))
    b = rows.where("r_regionkey != 2").select(F.col("r_name").alias("lang"), F.lit("b").alias("engine"), F.lit(65.0).cast("double").alias("score"))
    return D.matrix_markdown(a.unionByName(b), ["a", "b"])


@query("""SELECT l_suppkey AS doc, count(*) AS blocks, count(*) FILTER (l_partkey % 6 = 0) AS flagged, count(DISTINCT l_linenumber) AS pages, count(*) FILTER (l_partkey % 12 = 0) AS shrunk, string_agg(l_returnflag || l_partkey, '|' ORDER BY l_orderkey, l_linenumber, l_partkey) FILTER (l_partkey % 6 = 0) AS shown FROM lineitem GROUP BY l_suppkey""")
def analysis_payload(spark, sf_dir):
    """The payload's parts."""
    p = F.col("l_partkey")
    flags = F.when(p % 12 == 0, F.array(F.lit("shrunk"))).when(p % 6 == 0, F.array(F.lit("illegible"))).otherwise(F.array().cast("array<string>"))
    rows = items(spark, sf_dir).select(F.col("l_suppkey").alias("doc"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"), F.col("l_linenumber").alias("page"), F.lit("paragraph").alias("type"), flags.alias("flags"), F.concat("l_returnflag", p).alias("text"))
    schema = "counts struct<blocks:bigint,flagged:bigint,pages:bigint>, rendering struct<illegible:bigint,shrunk:bigint>, flagged array<struct<page:int,text:string>>"
    out = D.analysis(rows).select("doc", F.from_json("payload", schema).alias("j"))
    return out.select("doc", "j.counts.blocks", "j.counts.flagged", "j.counts.pages", "j.rendering.shrunk", F.nullif(F.array_join("j.flagged.text", "|"), F.lit("")).alias("shown"))


@query("""SELECT l_orderkey AS doc, l_linenumber AS ord, l_returnflag AS text, least(l_partkey % 90, 40)::DOUBLE AS x0, greatest(l_partkey % 90, 40)::DOUBLE AS x1, round(l_discount * 10, 3) AS conf, CASE WHEN round(l_discount * 10, 3) < 0.6 THEN 1 ELSE 0 END AS weak FROM lineitem WHERE l_partkey % 9 <> 0""")
def recognised_blocks(spark, sf_dir):
    """X25, Y20, Y21."""
    p = F.col("l_partkey")
    point = lambda x: F.struct(x.cast("double").alias("x"), F.lit(1.0).alias("y"))
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("page"), F.col("l_linenumber").alias("ord"), F.when(p % 9 == 0, " ").otherwise(F.concat(F.col("l_returnflag"), F.lit("\n"))).alias("text"), (F.col("l_discount") * 10).alias("score"), F.array(point(p % 90), point(F.lit(40))).alias("poly"))
    return D.recognised(rows).select("doc", "ord", "text", F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"), "conf", F.size("flags").alias("weak"))


@query("""SELECT n_name, CASE n_regionkey WHEN 0 THEN 'x,y' WHEN 1 THEN 'z' ELSE 'd' END AS chain, CASE WHEN n_nationkey >= 2 AND n_regionkey = 0 THEN 'ar' WHEN n_nationkey >= 2 AND n_regionkey = 1 THEN 'hi' END AS lang,
  CASE n_nationkey % 3 WHEN 0 THEN 'hin_Deva' WHEN 1 THEN 'ben_Beng' ELSE 'eng_Latn' END AS code, CASE WHEN n_nationkey % 3 < 2 AND n_regionkey > 1 THEN 'indic-en' WHEN n_nationkey % 3 < 2 THEN 'indic-indic' ELSE 'en-indic' END AS direction FROM nation""")
def script_routes(spark, sf_dir):
    """W19, Y16, Y22, F50, Y47."""
    script = F.when(F.col("n_regionkey") == 0, "Arabic").when(F.col("n_regionkey") == 1, "Devanagari").otherwise("Latin")
    rows = table(spark, sf_dir, "nation").withColumn("script", script)
    routes = spark.createDataFrame([("Arabic", ["x", "y"]), ("Devanagari", ["z"])], "script string, chain array<string>")
    code = D.indic_code(F.when(F.col("n_nationkey") % 3 == 0, "HI-in").when(F.col("n_nationkey") % 3 == 1, "bn").otherwise("fr"))
    other = D.indic_code(F.when(F.col("n_regionkey") > 1, "en").otherwise("ta"))
    return D.routed(rows, routes, ["d"]).select("n_name", F.array_join("chain", ",").alias("chain"), D.script_language(F.col("script"), F.col("n_nationkey") * 0.75, {"Arabic": "ar", "Devanagari": "hi"}).alias("lang"), code.alias("code"), D.indic_direction(code, other).alias("direction"))


@query("""SELECT p_partkey, CASE WHEN s LIKE 'title%' THEN 'title' WHEN s LIKE 'heading%' THEN 'heading' WHEN s LIKE '%list%' THEN 'list_item' ELSE 'paragraph' END AS type, CASE WHEN s LIKE 'heading%' THEN coalesce(nullif(regexp_replace(s, '[^0-9]', '', 'g'), '')::INT, 1) ELSE 0 END AS level, replace(m, ' ', '') AS latex
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'heading ' || (p_size % 4) WHEN 2 THEN 'heading' WHEN 3 THEN 'my list 2' ELSE 'body' END AS s, 's o f t ' || lower(substr(p_type, 1, 1)) AS m FROM part)""")
def paragraph_styles(spark, sf_dir):
    """F21, F24, Y5."""
    n = F.col("p_size")
    s = F.when(n % 5 == 0, "Title").when(n % 5 == 1, F.concat(F.lit("Heading "), n % 4)).when(n % 5 == 2, "Heading").when(n % 5 == 3, "My List 2").otherwise("Body")
    style = D.paragraph_style(s)
    return table(spark, sf_dir, "part").select("p_partkey", style["type"].alias("type"), style["level"].alias("level"), D.latex_closed(F.concat(F.lit("s o f t "), F.lower(F.substring("p_type", 1, 1)))).alias("latex"))


@query(r"""WITH t AS (SELECT doc_id, lang, ' ' || array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ') || ' ' AS x, regexp_matches(text, '\p{L}') AS letters FROM documents),
g AS (SELECT DISTINCT doc_id, lang, letters, substr(x, i, 3) AS gram FROM (SELECT *, unnest(range(1, greatest(length(x) - 2, 1) + 1)) AS i FROM t WHERE x IS NOT NULL)), c AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL),
p AS (SELECT lang, gram, 301 - row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS weight FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 300), s AS (SELECT g.doc_id, p.lang, sum(weight) AS w FROM g JOIN p ON p.gram = g.gram WHERE letters GROUP BY ALL),
b AS (SELECT doc_id, min(lang) AS lang_pred FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY w DESC) AS r FROM s) WHERE r = 1 GROUP BY doc_id) SELECT d.doc_id, b.lang_pred FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def segment_language(spark, sf_dir):
    """F47, with profiles of the documents' own languages."""
    docs = table(spark, sf_dir, "documents")
    return D.language_of(docs, D.language_profiles(docs))


@query("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS ord, CASE WHEN l_partkey % 3 > 0 THEN l_returnflag END AS translated, l_partkey FROM lineitem)
SELECT doc, ord, 'block' AS part, 0 AS n, translated AS text FROM b WHERE translated IS NOT NULL UNION ALL SELECT doc, ord, 'run', 0, 'a' || l_partkey FROM b UNION ALL SELECT doc, ord, 'run', 1, '' FROM b UNION ALL SELECT doc, ord, 'cell', 1, 'c' FROM b""")
def translated_holders(spark, sf_dir):
    """Y36, Y52."""
    p = F.col("l_partkey")
    run = lambda t: F.struct(F.lit(t).alias("text"), F.lit("old").alias("translated"))
    runs = D.collapsed_runs(F.array(run("x"), run("y")), F.concat(F.lit("a"), p))
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.when(p % 3 > 0, F.col("l_returnflag")).alias("translated"), runs["translated"].alias("runs"), F.array(F.lit(None).cast("string"), F.lit("c")).alias("cells"))
    return D.holders(rows)


@query("""SELECT o_custkey AS doc, o_orderkey AS page FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey BETWEEN 101 AND 500 OR o_orderkey >= 2000""")
def page_selection(spark, sf_dir):
    """`102-501,2001-` asked of documents with an odd number, nothing of the others."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("source_page"))
    wanted = pages.where("doc % 2 = 1").select("doc").distinct().select("doc", F.inline(T.pages_wanted(F.lit("102-501, x-y,2001-"))))
    return D.selected_pages(pages, wanted).select("doc", F.col("source_page").alias("page"))


@query(f"""WITH {_EVENTS}, l AS (SELECT doc_id AS doc, ord, line AS text, {_KEY.format('line')} AS key FROM ({_LINES})), w AS (SELECT key, min(text) AS text FROM l WHERE {_STRIP.format('text')} <> '' AND ord % 7 <> 3 GROUP BY key),
d AS (SELECT w.key, CASE WHEN tm.norm IS NULL THEN regexp_extract(w.text, '^\\s*') || '[en] ' || {_STRIP.format('w.text')} || regexp_extract(w.text, '\\s*$') ELSE tm.tgt_text END AS tgt, CASE WHEN tm.norm IS NULL THEN 'echo' ELSE 'memory' END AS origin FROM w LEFT JOIN tm ON tm.norm = w.key)
SELECT l.doc, l.ord, CASE WHEN l.ord % 7 <> 3 THEN d.tgt END AS tgt, CASE WHEN l.ord % 7 <> 3 THEN d.origin END AS origin FROM l LEFT JOIN d ON d.key = l.key""")
def translate_documents(spark, sf_dir):
    """All lines of all documents through memory, protection, the echo engine, restoring and scatter; each seventh line is code."""
    blocks = S.lines(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), "ord", F.when(F.col("ord") % 7 == 3, "code").otherwise("paragraph").alias("type"), F.col("line").alias("text"))
    tm = M.memory(tm_events(spark, sf_dir).withColumn("tgt_lang", F.lit("en")))
    return X.translate(blocks, X.Plan("", "en", [("echo", _tight_echo)], fuzzy=None), tm).blocks.select("doc", "ord", "tgt", "origin")


def _tight_echo(texts: list[str], source: str, target: str) -> list[str]:
    return E.echo([t.strip() for t in texts], source, target)


@query("""WITH t AS (SELECT conv_id AS id, turn AS t, text FROM conversations WHERE turn < 6), s AS (SELECT id, t, 'w' || t AS word, CASE WHEN t % 2 = 0 THEN 'bold' ELSE 'plain' END AS style FROM t), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
v AS (SELECT id, t AS j, style FROM s WHERE t <> 3), c AS (SELECT s.id, s.t, coalesce(last_value(v.style IGNORE NULLS) OVER (PARTITION BY s.id ORDER BY s.t), first_value(v.style IGNORE NULLS) OVER (PARTITION BY s.id ORDER BY s.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS style FROM s LEFT JOIN v ON v.id = s.id AND v.j = s.t),
r AS (SELECT *, CASE WHEN lag(style) OVER (PARTITION BY id ORDER BY t) = style THEN 0 ELSE 1 END AS new FROM c), k AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY t) - 1 AS run FROM r)
SELECT id, run::BIGINT AS run, style, string_agg('z' || t, ' ' ORDER BY t) || CASE WHEN max(t) = any_value(n.n) - 1 THEN '' ELSE ' ' END AS text FROM k JOIN n USING (id) GROUP BY id, run, style HAVING any_value(n.n) - CASE WHEN any_value(n.n) > 3 THEN 1 ELSE 0 END >= 0.3 * any_value(n.n)""")
def style_transfer(spark, sf_dir):
    """Runs of a word for each turn, a translation of as many words, linked one to one but for the fourth."""
    turns = table(spark, sf_dir, "conversations").where("turn < 6").select(F.col("conv_id").alias("id"), F.col("turn").alias("run"))
    runs = turns.withColumn("text", F.concat(F.lit("w"), F.col("run"), F.lit(" "))).withColumn("style", F.when(F.col("run") % 2 == 0, "bold").otherwise("plain"))
    targets = turns.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("run")), lambda r: F.concat(F.lit("z"), r)), " ").alias("translated"))
    linked = turns.where("run != 3").select("id", F.col("run").cast("int").alias("s"), F.col("run").cast("int").alias("t"))
    return A.restyled(runs, targets, linked).select("id", F.col("run").cast("long").alias("run"), "style", "text")


@query()
def box_fidelity(spark, sf_dir):
    """Pages against themselves with boxes a little moved; greedy matching has no SQL."""
    rows = boxes(spark, sf_dir)
    moved = rows.withColumns({"x0": F.col("x0") + 2, "x1": F.col("x1") + 2})
    return D.box_fidelity(rows, moved).select("doc", F.round("biou", 6).alias("biou"), F.round("coverage", 6).alias("coverage"), "n")


@query()
def merged_cells(spark, sf_dir):
    """Line items as cells of tables, some merged; slot filling has no SQL."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    cells = items(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), ((n - 1) / 3).cast("int").alias("row"), n.cast("int").alias("ord"), (1 + (p % 5 == 0).cast("int")).alias("rowspan"), (1 + (p % 4 == 0).cast("int")).alias("colspan"), F.col("l_returnflag").alias("text"))
    return D.placed_cells(cells, "doc")


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


#: Small files of each kind, and the ids of two texts of each that are replaced.
TEMPLATES = {
    "docx": (archives.docx_built([{"type": "title", "text": "a"}, {"type": "paragraph", "text": "b"}]), ("p0", "p1")),
    "odt": (_archive({"content.xml": '<o xmlns:t="urn:t"><t:h>a</t:h><t:p>b</t:p></o>'}), ("o0", "o1")),
    "epub": (_archive({"META-INF/container.xml": '<c><rootfile full-path="p.opf"/></c>', "p.opf": '<p><item id="x" href="x.html"/><itemref idref="x"/></p>', "x.html": "<html><body><h1>a</h1><p>b</p></body></html>"}), ("x#0", "x#1")),
    "xlsx": (_archive({"xl/worksheets/sheet1.xml": '<s xmlns="urn:s"><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></s>'}), ("sheet1!A1", "sheet1!B1")),
    "pptx": (_archive({"ppt/slides/slide1.xml": '<s xmlns:a="urn:a"><a:p><a:t>a</a:t></a:p></s>', "ppt/notesSlides/notesSlide1.xml": '<s xmlns:a="urn:a"><a:p><a:t>b</a:t></a:p></s>'}), ("slide1#0", "notesSlide1#0")),
}


@query("""WITH k(kind, a, b) AS (VALUES ('docx', 'title', 'paragraph'), ('odt', 'heading', 'paragraph'), ('epub', 'paragraph', 'paragraph'), ('xlsx', 'cell', 'cell'), ('pptx', 'paragraph', 'note'))
SELECT kind, s_suppkey, 0 AS ord, a AS type, s_name || ' & <b>' AS text FROM supplier, k UNION ALL SELECT kind, s_suppkey, 1, b, 'at ' || s_name FROM supplier, k""")
def office_round_trip(spark, sf_dir):
    """A file of each kind for each supplier, written with its texts and read again."""
    rows, found = table(spark, sf_dir, "supplier"), None
    for kind, (content, ids) in TEMPLATES.items():
        files = rows.select(F.concat("s_suppkey", F.lit(f".{kind}")).alias("path"), F.lit(bytearray(content)).alias("content"))
        texts = rows.select(F.concat("s_suppkey", F.lit(f".{kind}")).alias("path"), F.inline(F.array(F.struct(F.lit(ids[0]).alias("id"), F.concat("s_name", F.lit(" & <b>")).alias("text")), F.struct(F.lit(ids[1]).alias("id"), F.concat(F.lit("at "), "s_name").alias("text")))))
        read = K.blocks(archives.written_back(files, texts, kind), kind).select(F.lit(kind).alias("kind"), F.split("path", r"\.")[0].cast("long").alias("s_suppkey"), F.col("ord").cast("int").alias("ord"), "type", "text")
        found = read if found is None else found.unionByName(read)
    return found


@query("""SELECT p_partkey, ord, type, CASE ord WHEN 0 THEN p_name WHEN 1 THEN 'ä ' || p_type WHEN 2 THEN p_brand ELSE 'x' || chr(9) || p_brand END AS text FROM part, (VALUES (0, 'title'), (1, 'paragraph'), (2, 'list_item'), (3, 'table')) t(ord, type)""")
def html_round_trip(spark, sf_dir):
    """Pages in three encodings read as blocks; Latin-1 of even length would pass for UTF-16."""
    part = table(spark, sf_dir, "part")
    page = F.concat(F.lit("<html><head><title>no</title></head><body><script>var x='<p>';</script><h1>"), "p_name", F.lit("</h1><p>ä "), "p_type", F.lit("</p><ul><li>"), "p_brand", F.lit("</ul><table><tr><th>x</th><td>"), "p_brand", F.lit("</td></tr></table></body></html>"))
    content = F.when(F.col("p_partkey") % 3 == 0, F.encode(page, "UTF-8")).when(F.col("p_partkey") % 3 == 1, F.encode(page, "UTF-16")).otherwise(F.encode(F.concat(page, F.when(F.length(page) % 2 == 0, " ").otherwise("")), "ISO-8859-1"))
    return K.blocks(part.select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")), "html").select(F.col("path").cast("long").alias("p_partkey"), F.col("ord").cast("int").alias("ord"), "type", "text")


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'zip' WHEN 3 THEN 'subtitle' WHEN 4 THEN 'html' WHEN 5 THEN 'image' ELSE 'text' END AS kind, c_custkey % 5 = 0 AS sidecar FROM customer""")
def file_kinds(spark, sf_dir):
    """S1, S2, S41."""
    k = F.col("c_custkey")
    name = F.concat(F.col("c_name"), F.when(k % 5 == 0, ".ref.de").otherwise(""), F.when(k % 7 == 1, ".docx").when(k % 7 == 2, ".bin").when(k % 7 == 3, ".srt").otherwise(F.when(k % 5 == 0, ".txt").otherwise(".dat")))
    path = F.when((k % 5 == 0) & (k % 7).isin(1, 2, 3), F.concat(F.lit("x/"), name)).otherwise(name)
    head = F.when(k % 7 == 0, F.unhex(F.lit("255044462D312E37"))).when((k % 7).isin(1, 2), F.unhex(F.lit("504B030400000000"))).when(k % 7 == 4, F.encode(F.lit(" <!DOCTYPE html><p>x"), "UTF-8")).when(k % 7 == 5, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.encode(F.lit("plain"), "UTF-8"))
    beside = K.sidecar(F.concat(F.lit("x/a"), F.when(k % 5 == 0, ".ref.de.txt").otherwise(".txt")))
    return table(spark, sf_dir, "customer").select(k, K.kind(path, head).alias("kind"), beside.alias("sidecar"))


@query("""SELECT p_partkey, p_brand AS term, p_type AS rendering FROM part WHERE p_size % 4 <> 0""")
def glossary_objects(spark, sf_dir):
    """A JSON object for each part, with a blank entry, and blank ones alone for some."""
    value = F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").withColumn("json", F.to_json(F.create_map(F.col("p_brand"), value, F.lit(" "), F.lit("x"))))
    found = rows.select("p_partkey", F.struct("json").alias("j"))
    return found.select("p_partkey", F.col("j.json").alias("json")).join(B.glossary_json(found.select(F.col("j.json").alias("json"))).distinct(), F.col("json").contains(F.concat(F.lit('"'), "term", F.lit('":"'), "rendering", F.lit('"')))).select("p_partkey", "term", "rendering")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE lower(n_name) || '|' || n_name END AS texts, n_name || '|b' AS listed FROM nation""")
def reply_parsing(spark, sf_dir):
    """Replies with all ids or without one; the first list in a reply, each text once."""
    k = F.col("n_nationkey")
    reply = F.when(k % 3 == 0, F.to_json(F.create_map(F.lit("0"), F.col("n_name")))).otherwise(F.to_json(F.create_map(F.lit("0"), F.col("n_name"), F.lit("1"), F.lower("n_name"))))
    listed = F.concat(F.lit('Sure: ["'), "n_name", F.lit('", "b", "'), "n_name", F.lit('"] done'))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(E.reply_by_id(reply, F.array(F.lit("1"), F.lit("0"))), "|").alias("texts"), F.array_join(E.reply_list(listed), "|").alias("listed"))


@query("""SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey = 2, n_nationkey) - 1 AS place FROM nation""")
def engine_order(spark, sf_dir):
    """Engines in their order, tripped ones last; nations stand for engines."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("ord"), (F.col("n_regionkey") == 2).alias("tripped"))
    return C.live_first(rows).withColumn("place", F.row_number().over(Window.orderBy("tripped", "ord")) - 1).select("n_nationkey", F.col("place").cast("long").alias("place"))


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([V.same_protected(x, y) for x, y in zip(a, b, strict=True)])


@query("""SELECT c_custkey, c_custkey % 3 <> 1 AS same, CASE WHEN c_custkey % 2 = 0 THEN 'One two three four.| Five six seven eight.' ELSE 'onetwothr|eefourfiv|esix' END AS pieces FROM customer""")
def protected_tokens(spark, sf_dir):
    """the same tokens in any order, or one changed; texts cut at a sentence mark, or hard."""
    k = F.col("c_custkey")
    source = F.concat(F.lit("See https://own.test/"), k, F.lit(" at 12:30, 40 %"))
    target = F.when(k % 3 == 1, F.concat(F.lit("40 % um 12:31 auf https://own.test/"), k)).otherwise(F.concat(F.lit("40 % um 12:30 auf https://own.test/"), k))
    pieces = F.pandas_udf(lambda x: x.map(lambda t: "|".join(V.cut(t, 25 if " " in t else 9))), "string")
    text = F.when(k % 2 == 0, "One two three four. Five six seven eight.").otherwise("onetwothreefourfivesix")
    return table(spark, sf_dir, "customer").select("c_custkey", F.pandas_udf(_same, "boolean")(source, target).alias("same"), pieces(text).alias("pieces"))


@query(f"""WITH {_BOXES} SELECT doc, page, ord, text, least(x1, 300) - greatest(x0, 200) >= 0.5 * least(x1 - x0, 100) AS same FROM bx""")
def column_neighbours(spark, sf_dir):
    """F54 against a column from 200 to 300."""
    column = F.struct(F.lit(200.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(1.0).alias("y1"))
    return boxes(spark, sf_dir).select("doc", "page", "ord", "text", G.same_column(G.box(), column).alias("same"))
