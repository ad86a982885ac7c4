"""More queries over pages, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.functions import metrics as X
from papyrion.functions import text as T
from papyrion.operators import layout as L
from papyrion.operators import pages as P
from papyrion.plans.layout_queries import _AREA, _BOXES, _SHARED, boxes
from papyrion.plans.tables import table
from papyrion.plans.text_queries import turn_pairs, _TURN_PAIRS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""WITH {_BOXES} SELECT a.doc, a.page, a.ord, min(b.ord) AS block FROM bx a JOIN bx b ON a.doc = b.doc AND a.page = b.page WHERE a.type = 'caption' AND b.type = 'paragraph' AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY ALL""")
def link_attach(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return P.attached_links(rows.where("type = 'caption'"), rows.where("type = 'paragraph'"))


@query(f"""WITH {_BOXES}, f AS (SELECT * FROM bx a WHERE a.type = 'figure' AND NOT EXISTS (SELECT 1 FROM bx b WHERE b.doc = a.doc AND b.page = a.page AND b.type = 'table' AND {_SHARED} > 0.5 * ({_AREA.format('a')} + {_AREA.format('b')} - {_SHARED})))
SELECT a.doc, a.page, a.ord, coalesce(max(b.y0) + 0.5, 0.5)::DOUBLE AS reading_order FROM f a LEFT JOIN bx b ON b.doc = a.doc AND b.page = a.page AND b.type = 'table' AND b.y0 <= a.y0 GROUP BY a.doc, a.page, a.ord""")
def region_figures(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("reading_order", F.col("y0"))
    return P.added_figures(rows.where("type = 'table'"), rows.where("type = 'figure'")).select("doc", "page", "ord", "reading_order").distinct()


@query(f"""WITH {_BOXES}, p AS (SELECT a.doc, a.page, a.ord, b.ord AS bo, length(a.text) <= 200 AND {_AREA.format('a')} <= 0.5 * {_AREA.format('b')} AS small FROM bx a JOIN bx b ON a.doc = b.doc AND a.page = b.page WHERE a.type = 'paragraph' AND b.type = 'table' AND {_SHARED} / ({_AREA.format('a')}) >= 0.7),
m AS (SELECT doc, page, ord, arg_min(small, bo) AS small FROM p GROUP BY ALL) SELECT a.doc, a.page, a.ord, m.small IS NOT NULL AS in_region FROM bx a LEFT JOIN m USING (doc, page, ord) WHERE a.type = 'paragraph' AND coalesce(NOT m.small, true)""")
def text_in_regions(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return P.within_regions(rows.where("type = 'paragraph'"), rows.where("type = 'table'")).select("doc", "page", "ord", "in_region")


@query()
def containment_dedup(spark, sf_dir):
    return P.containment_dedup(boxes(spark, sf_dir))


@query()
def multi_column(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return P.multi_column(P.two_columns(L.columns_of(rows), rows))


@query()
def typing_match(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return P.typing_match(rows.where("type != 'table'"), rows.where("type != 'figure'"))


@query(f"""WITH {_BOXES}, k AS (SELECT *, (x0 > 250) AS placed FROM bx) SELECT doc, page, ord, row_number() OVER (PARTITION BY doc, page ORDER BY type = 'caption', CASE WHEN placed THEN x0 ELSE 1e18 END, y0, x0, ord) - 1 AS reading_order FROM k""")
def region_order(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("order", F.when(F.col("x0") > 250, F.col("x0")).otherwise(0)).withColumn("type", F.when(F.col("type") == "caption", "footnote").otherwise(F.col("type")))
    return P.region_order(rows).select("doc", "page", "ord", F.col("reading_order").cast("long").alias("reading_order"))


@query("""WITH m AS (SELECT max(value) AS top FROM events), p AS (SELECT user_id AS doc, avg(value / top) AS mean, count(*) AS n_blocks, count(*) FILTER (event_type = 'click') AS n_table FROM events, m GROUP BY user_id)
SELECT doc, round(mean, 6) AS mean, n_blocks, n_table, CASE WHEN mean >= 0.9 THEN 'clean' WHEN mean >= 0.7 THEN 'light' ELSE 'heavy' END AS damage FROM p""")
def document_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    rows = rows.join(rows.agg(F.max("value").alias("top"))).select(F.col("user_id").alias("doc"), (F.col("value") / F.col("top")).alias("conf"), F.when(F.col("event_type") == "click", "table").otherwise("x").alias("type"))
    return P.profile(rows).select("doc", F.round("mean", 6).alias("mean"), "n_blocks", "n_table", "damage")


@query(rf"""WITH p AS ({_TURN_PAIRS}), t AS (SELECT conv_id, tgt, unnest(list_distinct(regexp_extract_all(src, '\p{{L}}{{4,}}'))) AS token FROM p) SELECT conv_id, round(avg(contains(tgt, token)::INT), 6) AS share, count(*) AS n FROM t GROUP BY conv_id""")
def entity_preservation(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).withColumn("tokens", F.array_distinct(F.regexp_extract_all("src", F.lit(r"\p{L}{4,}"), F.lit(0))))
    return P.preserved(rows, "tokens", "tgt", "conv_id").withColumn("share", F.round("share", 6))


@query("""WITH s AS (SELECT l_suppkey AS doc, sum(length(l_returnflag || l_partkey)) AS chars, count(*) FILTER (l_linenumber = 1) AS tables, count(*) FILTER (l_linenumber = 2) AS figures FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), o AS (SELECT l_suppkey AS doc, sum(length(l_returnflag || l_partkey)) AS chars, count(*) FILTER (l_linenumber = 1) AS tables, count(*) FILTER (l_linenumber = 2) AS figures FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT s.doc, concat_ws(',', CASE WHEN s.chars > 200 AND coalesce(o.chars, 0) < 0.5 * s.chars THEN 'text' END, CASE WHEN coalesce(o.tables, 0) < s.tables THEN 'tables' END, CASE WHEN coalesce(o.figures, 0) < s.figures THEN 'figures' END) AS lacks FROM s LEFT JOIN o USING (doc)""")
def verify_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    n = lambda status: rows.where(F.col("l_linestatus") == status).groupBy(F.col("l_suppkey").alias("doc")).agg(F.sum(F.length(F.concat("l_returnflag", "l_partkey"))).alias("chars"), F.count_if(F.col("l_linenumber") == 1).alias("tables"), F.count_if(F.col("l_linenumber") == 2).alias("figures"))
    return P.verified(n("O"), n("F"))


@query("""WITH t AS (SELECT p_partkey, array_to_string(list_transform(range(1 + p_size % 4), lambda i: 'r' || chr((97 + p_partkey % 3)::INT) || chr((102 + i)::INT)), '') AS a, array_to_string(list_transform(range(1 + p_size % 3), lambda i: 'r' || chr((97 + p_size % 3)::INT) || chr((102 + i)::INT)), '') AS b FROM part)
SELECT p_partkey, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS similarity FROM t""")
def table_similarity(spark, sf_dir):
    """Tables of one to four rows against tables of one to three, as token sequences."""
    grid = lambda rows, first: F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.array(F.char(97 + first), F.char(102 + i)))
    n, k = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", P.table_tokens(grid(1 + n % 4, k % 3)).alias("a"), P.table_tokens(grid(1 + n % 3, n % 3)).alias("b"))
    return rows.select("p_partkey", F.round(X.sequence_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))



@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Cyrillic' WHEN 1 THEN 'Han' ELSE 'Latin' END AS script, c_custkey % 3 = 0 AS crosses FROM customer""")
def script_routing(spark, sf_dir):
    lang = F.when(F.col("c_custkey") % 3 == 0, "ru").when(F.col("c_custkey") % 3 == 1, "zh-CN").otherwise("de")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.script_of_language(lang).alias("script"), T.cross_script(lang, F.when(F.col("c_custkey") % 3 == 1, "ja").otherwise("en")).alias("crosses"))
