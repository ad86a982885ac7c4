"""More of pages: regions, links, drawings, spans, typing and layout checks, document profiles and comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions import geometry as G
from papyrion.functions import text as T
from papyrion.operators.layout import PAGE, boxes, matches, pairs_on_page, sides, whole_pages


def added_figures(regions: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures that no region overlaps by over 0.5 IoU, ordered half a step after the last region above them."""
    fresh = pairs_on_page(figures, regions, G.iou(boxes("a"), boxes("b")) > 0.5, "left_anti")
    above = pairs_on_page(fresh, regions, F.col("b.y0") <= F.col("a.y0")).groupBy(F.col("a.doc").alias("doc"), F.col("a.page").alias("page"), F.col("a.ord").alias("ord")).agg((F.max("b.reading_order") + 0.5).alias("reading_order"))
    return fresh.drop("reading_order").join(above, [*PAGE, "ord"], "left").withColumn("reading_order", F.coalesce("reading_order", F.lit(0.5)))


def attached_links(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each link with the first block that its centre lies in."""
    cx, cy = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2
    hit = cx.between(F.col("b.x0"), F.col("b.x1")) & cy.between(F.col("b.y0"), F.col("b.y1"))
    return pairs_on_page(links, blocks, hit).groupBy(F.col("a.doc").alias("doc"), F.col("a.page").alias("page"), F.col("a.ord").alias("ord")).agg(F.min("b.ord").alias("block"))


def line_art(drawings: DataFrame, least: float = 3.0) -> DataFrame:
    """Drawings of a least length that don't fill 95 % of the page both ways."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return drawings.where((F.greatest(w, h) >= least) & ~((w >= 0.95 * F.col("width")) & (h >= 0.95 * F.col("height"))))


def background(drawings: DataFrame) -> DataFrame:
    """The last fill of nearly a whole page that isn't white."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    full = (w >= 0.95 * F.col("width")) & (h >= 0.95 * F.col("height")) & (F.col("fill") != "#ffffff")
    return drawings.where(full).groupBy(*PAGE).agg(F.max_by("fill", "ord").alias("fill"))


def quads(points: Column) -> Column:
    """Boxes of each four points of an array of (x, y)."""
    four = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points), F.lit(1)), F.lit(4)), lambda i: F.slice(points, i, 4))
    return F.transform(F.filter(four, lambda q: F.size(q) == 4), G.hull)


def outline_page(paths: Column, chars: Column) -> Column:
    """a page whose text is drawn: 2,000 paths or more and under 100 characters."""
    return (paths >= 2000) & (chars < 100)


def alignment(left: Column, right: Column, width: Column, short: Column, tolerance: float = 0.05) -> Column:
    """centre or right by the margins, for headings and lines of up to 60 characters; else left."""
    even = F.abs(left - (width - right)) <= tolerance * width
    return F.when(short & even & (left > 0.1 * width), "center").when(short & (width - right <= 0.1 * width) & (left > 0.4 * width), "right").otherwise("left")


def line_spacing(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """the median distance of baselines over the size, if it's within 0.9 and 3.0."""
    gap = (F.col("y1") - F.lag("y1").over(Window.partitionBy(*by).orderBy(order))) / F.col("size")
    out = lines.withColumn("gap", gap).groupBy(*by).agg(F.median("gap").alias("spacing"))
    return out.withColumn("spacing", F.when(F.col("spacing").between(0.9, 3.0), F.col("spacing")))


def respaced(glyphs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Text of lines from glyphs, with a space where the gap is over 0.4 of the line's median glyph width."""
    w = Window.partitionBy(*by).orderBy(order)
    middle = F.median(F.col("x1") - F.col("x0")).over(Window.partitionBy(*by))
    wide = F.coalesce(F.col("x0") - F.lag("x1").over(w) > 0.4 * middle, F.lit(False))
    rows = glyphs.withColumn("t", F.concat(F.when(wide, " ").otherwise(""), F.col("char")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "t"))), lambda x: x["t"]), "").alias("text"))


def spacing_adopted(old: Column, new: Column) -> Column:
    """the respaced text if it's the same but for space and has more spaces."""
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return F.when((bare(old) == bare(new)) & (F.regexp_count(new, F.lit(" ")) > F.regexp_count(old, F.lit(" "))), new).otherwise(old)


def region_text(digital: Column, recognised: Column) -> Column:
    """digital text, unless it's blank or the recognised one holds mathematics."""
    return F.when((T.strip(F.coalesce(digital, F.lit(""))) == "") | F.coalesce(recognised, F.lit("")).contains("$"), recognised).otherwise(digital)


def flags_style(flags: Column) -> Column:
    """A span's flag bits as a style."""
    bit = lambda n: flags.bitwiseAND(F.lit(1 << n)) != 0
    return F.struct(bit(0).alias("sup"), bit(1).alias("italic"), bit(2).alias("serif"), bit(3).alias("mono"), bit(4).alias("bold"))


def hex_color(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb), 6, "0")))


def within_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """P5: blocks without those of up to 200 characters and half a region's area that lie in a figure, formula or table; larger ones in one are flagged."""
    inside = G.contained(boxes("a"), boxes("b"))
    small = (F.length("a.text") <= 200) & (G.area(boxes("a")) <= 0.5 * G.area(boxes("b")))
    first = pairs_on_page(blocks, regions.where(F.col("type").isin("figure", "formula", "table")), inside).groupBy(F.col("a.doc").alias("doc"), F.col("a.page").alias("page"), F.col("a.ord").alias("ord")).agg(F.min_by(small, "b.ord").alias("small"))
    out = blocks.join(first, [*PAGE, "ord"], "left")
    return out.where(F.coalesce(~F.col("small"), F.lit(True))).withColumn("in_region", F.col("small").isNotNull()).drop("small")


def contained_once(texts: list[str]) -> list[tuple[int, str]]:
    """Texts with those of 15 characters or more dropped that equal, or by over 20 characters lie in, another; the first's place, the longest's text."""
    keys = [" ".join(t.lower().split()) for t in texts]
    kept: list[list] = []
    for place, (key, text) in enumerate(zip(keys, texts, strict=True)):
        for entry in kept if len(key) >= 15 else ():
            other = entry[2]
            if len(other) >= 15 and (key == other or len(key) > 20 and key in other or len(other) > 20 and other in key):
                if len(key) > len(other):
                    entry[1], entry[2] = text, key
                break
        else:
            kept.append([place, text, key])
    return [(p, t) for p, t, _ in kept]


def _contained(page: pd.DataFrame) -> pd.DataFrame:
    page = page.sort_values("ord", ignore_index=True)
    kept = contained_once(page["text"].fillna("").tolist())
    at = [p for p, _ in kept]
    return pd.DataFrame({"doc": page["doc"].iloc[at].tolist(), "page": page["page"].iloc[at].tolist(), "ord": page["ord"].iloc[at].tolist(), "text": [t for _, t in kept]})


def containment_dedup(blocks: DataFrame) -> DataFrame:
    """(doc, page, ord, text)."""
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in (*PAGE, "ord")}
    return blocks.select(*PAGE, "ord", "text").groupBy(*PAGE).applyInPandas(_contained, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", text string")


def two_columns(columns: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, two) from the columns of :func:`layout.columns_of`: two columns of two blocks or more, each under 60 % of the width, that overlap vertically by over 0.4."""
    spans = columns.join(blocks, [*PAGE, "ord"]).groupBy(*PAGE, "column").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("width").alias("width"))
    narrow = spans.where((F.col("n") >= 2) & (F.col("x1") - F.col("x0") < 0.6 * F.col("width")))
    shared = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    tall = F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0"))
    hits = pairs_on_page(narrow, narrow, (F.col("a.column") < F.col("b.column")) & (shared > 0.4 * tall)).select(F.col("a.doc").alias("doc"), F.col("a.page").alias("page")).distinct()
    return blocks.select(*PAGE).distinct().join(hits.withColumn("two", F.lit(True)), list(PAGE), "left").withColumn("two", F.coalesce("two", F.lit(False)))


def multi_column(pages: DataFrame) -> DataFrame:
    """P10: documents of which half the pages, one at least, have two columns."""
    return pages.groupBy("doc").agg((F.count_if("two") >= F.greatest(F.lit(1), F.floor(F.count("*") / 2))).alias("multi_column"))


def guessed_columns(blocks: DataFrame) -> DataFrame:
    """Whether the first page has six blocks, three of them in each half."""
    left = F.col("x1") <= 0.55 * F.col("width")
    right = F.col("x0") >= 0.45 * F.col("width")
    n = blocks.where("page = 0").groupBy("doc").agg(F.count("*").alias("n"), F.count_if(left).alias("l"), F.count_if(right).alias("r"))
    return n.select("doc", ((F.col("n") >= 6) & (F.col("l") >= 3) & (F.col("r") >= 3)).alias("two"))


def region_order(regions: DataFrame) -> DataFrame:
    """Regions of a page by their order, unplaced ones after, notes and references last, then by height."""
    last = F.col("type").isin("footnote", "reference")
    placed = F.max(F.col("order") > 0).over(Window.partitionBy(*PAGE))
    key = F.when(placed, F.when(F.col("order") > 0, F.col("order").cast("double")).otherwise(F.lit(float("inf")))).otherwise(F.col("y0"))
    w = Window.partitionBy(*PAGE).orderBy(last, key, "y0", "x0", "ord")
    return regions.withColumn("reading_order", F.row_number().over(w) - 1)


def resnapped(blocks: DataFrame) -> DataFrame:
    """Captions (column anchor: their block's ord) take the place after their anchor in reading order."""
    anchors = blocks.select("doc", F.col("ord").alias("anchor"), F.col("reading_order").alias("at"))
    moved = blocks.join(anchors, ["doc", "anchor"], "left").withColumn("key", F.coalesce(F.col("at") + 0.5, F.col("reading_order").cast("double")))
    w = Window.partitionBy("doc").orderBy("key", "ord")
    return moved.withColumn("reading_order", F.row_number().over(w) - 1).drop("at", "key")


def _typed(least: float):
    def run(rows: pa.Table, page: np.ndarray) -> pa.Table:
        a, b, _ = matches(rows, page, least)
        kinds = pa.table([rows.column("type").take(a), rows.column("type").take(b)], ["reference", "found"])
        return kinds.group_by(["reference", "found"]).aggregate([([], "count_all")]).rename_columns(["reference", "found", "n"])

    return run


def typing_match(reference: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """(reference, found, n): types of matched blocks of at least so much IoU."""
    return whole_pages(sides(reference, found, "type"), _typed(least), "reference string, found string, n bigint").groupBy("reference", "found").agg(F.sum("n").alias("n"))


def precision_recall(confusion: DataFrame) -> DataFrame:
    """Precision and recall of each type from (reference, found, n)."""
    ref = confusion.groupBy(F.col("reference").alias("type")).agg(F.sum("n").alias("r"))
    hyp = confusion.groupBy(F.col("found").alias("type")).agg(F.sum("n").alias("h"))
    hit = confusion.where("reference = found").select(F.col("reference").alias("type"), F.col("n").alias("hit"))
    out = ref.join(hyp, "type", "full").join(hit, "type", "left").na.fill(0, ["r", "h", "hit"])
    return out.select("type", F.when(F.col("h") > 0, F.col("hit") / F.col("h")).alias("precision"), F.when(F.col("r") > 0, F.col("hit") / F.col("r")).alias("recall"))


def table_tokens(rows: Column) -> Column:
    """A table (array<array<string>>) as the sequence of its row and cell tokens."""
    return F.flatten(F.transform(rows, lambda r: F.concat(F.array(F.lit("<tr>")), F.transform(r, lambda c: F.concat(F.lit("<td>"), T.collapsed(F.coalesce(c, F.lit(""))))))))


def profile(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """A10: a document's damage by mean confidence (clean from 0.9, light from 0.7, else heavy), and its structure."""
    mean = F.coalesce(F.avg("conf"), F.lit(1.0))
    out = blocks.groupBy(by).agg(mean.alias("mean"), F.count("*").alias("n_blocks"), *(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("table", "figure", "formula")))
    return out.withColumn("damage", F.when(F.col("mean") >= 0.9, "clean").when(F.col("mean") >= 0.7, "light").otherwise("heavy"))


def verified(source: DataFrame, output: DataFrame, by: str = "doc") -> DataFrame:
    """What an output lacks: under half the text of a source of over 200 characters, tables or figures missing."""
    both = source.select(by, *(F.col(c).alias(f"s_{c}") for c in ("chars", "tables", "figures"))).join(output.select(by, "chars", "tables", "figures"), by, "left").na.fill(0, ["chars", "tables", "figures"])
    found = F.array_compact(F.array(F.when((F.col("s_chars") > 200) & (F.col("chars") < 0.5 * F.col("s_chars")), F.lit("text")), F.when(F.col("tables") < F.col("s_tables"), F.lit("tables")), F.when(F.col("figures") < F.col("s_figures"), F.lit("figures"))))
    return both.select(by, F.array_join(found, ",").alias("lacks"))


def preserved(pairs: DataFrame, tokens: str, target: str, *by: str) -> DataFrame:
    """The share of tokens that the target still holds."""
    rows = pairs.select(*by, F.col(target).alias("t"), F.explode(tokens).alias("token"))
    return rows.groupBy(*by).agg(F.avg(F.col("t").contains(F.col("token")).cast("double")).alias("share"), F.count("*").alias("n"))


def outline(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Outline entries on the output's pages: mapped, kept within them, dropped where the source page was trimmed."""
    n = pages.groupBy("doc").agg(F.max("out_page").alias("last"))
    out = entries.join(pages, ["doc", "page"]).join(n, "doc")
    return out.withColumn("out_page", F.greatest(F.lit(0), F.least("out_page", "last"))).drop("last")
