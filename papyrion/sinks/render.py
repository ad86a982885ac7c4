"""Documents rendered from block rows: one output row a document, its blocks gathered in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(order: Column, text: Column, separator: str) -> Column:
    """An aggregate: texts in order, joined; nulls left out."""
    rows = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def escaped(x: Column) -> Column:
    """Text as HTML text."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def run_markdown(text: Column, style: Column) -> Column:
    """K3: a run with its marks, the innermost first: script, bold, italic, strike, underline, capitals, highlight, link."""
    on = lambda name: F.coalesce(style[name], F.lit(False))
    x = F.when(on("sup"), F.concat(F.lit("<sup>"), text, F.lit("</sup>"))).when(on("sub"), F.concat(F.lit("<sub>"), text, F.lit("</sub>"))).otherwise(text)
    for name, before, after in (("bold", "**", "**"), ("italic", "*", "*"), ("strike", "~~", "~~"), ("underline", "<u>", "</u>")):
        x = F.when(on(name), F.concat(F.lit(before), x, F.lit(after))).otherwise(x)
    x = F.when(on("caps"), F.upper(x)).otherwise(x)
    x = F.when(on("highlight"), F.concat(F.lit("=="), x, F.lit("=="))).otherwise(x)
    return F.when(style["link"].isNotNull(), F.concat(F.lit("["), x, F.lit("]("), style["link"], F.lit(")"))).otherwise(x)


def table_markdown(rows: Column) -> Column:
    """K4: array<array<string>> as a table whose first row is the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(rows[0])), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.size(rows)), line)), "\n"))


def table_html(rows: Column) -> Column:
    """K5: array<array<string>> as an HTML table."""
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))


def block_markdown(kind: Column, text: Column, level: Column, bilingual: Column | None = None) -> Column:
    """K2: one block; headings two to six deep, list items indented by level, captions italic, formulas fenced."""
    depth = F.greatest(F.lit(2), F.least(F.lit(6), F.coalesce(level, F.lit(2))))
    x = (
        F.when(kind == "title", F.concat(F.lit("# "), text))
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.repeat(F.lit("  "), F.coalesce(level, F.lit(0))), F.lit("- "), text))
        .when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*")))
        .when(kind == "formula", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .otherwise(text)
    )
    return x if bilingual is None else F.when(bilingual.isNotNull(), F.concat(F.lit("> "), F.replace(bilingual, F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), x)).otherwise(x)


def markdown(blocks: DataFrame, by: str, order: str, kind: str = "type", text: str = "text", level: str = "level") -> DataFrame:
    """K2: (by, markdown)."""
    one = block_markdown(F.col(kind), F.col(text), F.col(level))
    return blocks.groupBy(by).agg(F.concat(gathered(F.col(order), one, "\n\n"), F.lit("\n")).alias("markdown"))


def styled(text: Column, style: Column) -> Column:
    """A span with the style's properties."""
    parts = F.array_compact(F.array(
        F.when(style["bold"], F.lit("font-weight:bold")), F.when(style["italic"], F.lit("font-style:italic")), F.when(style["size"].isNotNull(), F.concat(F.lit("font-size:"), style["size"].cast("string"), F.lit("pt"))), F.when(style["color"].isNotNull(), F.concat(F.lit("color:"), style["color"])),
    ))
    return F.when(F.size(parts) == 0, escaped(text)).otherwise(F.concat(F.lit('<span style="'), F.array_join(parts, ";"), F.lit('">'), escaped(text), F.lit("</span>")))


def review(segments: DataFrame, by: str, order: str) -> DataFrame:
    """(by, payload): a document's segments as JSON in order, with their findings."""
    one = F.struct(F.col(order).alias("o"), F.struct(F.col("id").alias("id"), F.col("src").alias("source"), F.col("tgt").alias("translation"), F.col("flags").alias("flags")).alias("s"))
    return segments.groupBy(by).agg(F.to_json(F.struct(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("segments"))).alias("payload"))


def report(counts: DataFrame, by: str, labels: dict[str, str]) -> DataFrame:
    """(by, report): a heading and a line for each count that isn't zero."""
    lines = F.array_compact(F.array(*(F.when(F.col(c) != 0, F.concat(F.lit(f"- {name}: "), F.col(c).cast("string"))) for c, name in labels.items())))
    return counts.select(by, F.concat(F.lit("# Report\n\n"), F.when(F.size(lines) == 0, "nothing to report").otherwise(F.array_join(lines, "\n")), F.lit("\n")).alias("report"))


def output_name(path: Column, extension: Column, lang: Column) -> Column:
    """The default name of a result: the source's, the language, the extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("."), lang, F.lit("."), extension)
