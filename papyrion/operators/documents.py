"""Rules over a document's blocks, spans, runs and scores: what is translated, what is weak, how a style is chosen, what a report says."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions import text as T
from papyrion.operators.layout import PAGE, matches, sides, whole_pages

# Types of blocks that aren't translated, and bounds of what is kept, cropped, repaired or trusted.
NON_TRANSLATABLE = ("code", "formula", "page_number", "stamp", "signature", "figure")
MAX_PAGES, MAX_PIXELS = 5000, 300_000_000
INLINE_WIDTH, INLINE_HEIGHT = 50.0, 20.0
REPAIR_CHARS, REPAIR_GROWTH, REPAIR_SLACK = 8, 1.5, 10
OCR_LEAST, WEAK_OCR, WEAK_SHARE, QE_LEAST = 0.5, 0.6, 0.25, 0.75
SAMPLE_BLOCKS, SAMPLE_CHARS = 12, 20


def translatable(kind: Column, text: Column) -> Column:
    """whether a block is of a type that is translated and has text."""
    return ~kind.isin(*NON_TRANSLATABLE) & (T.strip(F.coalesce(text, F.lit(""))) != "")


def output_text(translated: Column, text: Column) -> Column:
    """what is rendered: the translation if there is one, an empty one too, else the source."""
    return F.coalesce(translated, text)


def flagged(blocks: DataFrame, flags: str = "flags") -> DataFrame:
    """Blocks with a flag."""
    return blocks.where(F.size(flags) > 0)


def collapsed_runs(runs: Column, text: Column) -> Column:
    """Runs of a block that is translated as a whole: the first holds the translation, the others nothing."""
    return F.transform(runs, lambda r, i: r.withField("translated", F.when(i == 0, text).otherwise("")))


def cleaned_members(runs: Column) -> Column:
    """runs or cells (structs with a text) with their texts cleaned."""
    return F.transform(runs, lambda r: r.withField("text", T.cleaned(r["text"])))


def directed(rows: DataFrame, text: str, lang: Column) -> DataFrame:
    """Rows (blocks, runs or cells) with rtl by their output text, and align `right` for right-to-left ones that have none."""
    out = rows.withColumn("rtl", T.direction(F.col(text), lang) == "rtl")
    return out.withColumn("align", F.when(F.col("rtl") & F.col("align").isNull(), "right").otherwise(F.col("align"))) if "align" in rows.columns else out


def holders(blocks: DataFrame) -> DataFrame:
    """(doc, ord, part, n, text): all that holds a translation: the block (part `block`), its runs, its cells (arrays runs and cells of texts)."""
    whole = blocks.where("translated is not null").select("doc", "ord", F.lit("block").alias("part"), F.lit(0).alias("n"), F.col("translated").alias("text"))
    one = lambda name, part: blocks.select("doc", "ord", F.lit(part).alias("part"), F.posexplode(name).alias("n", "text")).where("text is not null")
    return whole.unionByName(one("runs", "run")).unionByName(one("cells", "cell"))


def latex_closed(x: Column) -> Column:
    """single spaces between letters gone, in formulas that a recogniser has spelt out."""
    return F.regexp_replace(x, "(?<=[A-Za-z]) (?=[A-Za-z])", "")


def paragraph_style(style: Column) -> Column:
    """Struct (type, level) of a paragraph by its style's name."""
    s = F.lower(F.coalesce(style, F.lit("")))
    digits = F.regexp_replace(s, r"\P{Nd}", "")
    kind = F.when(s.startswith("title"), "title").when(s.startswith("heading"), "heading").when(s.contains("list"), "list_item").otherwise("paragraph")
    level = F.when(~s.startswith("title") & s.startswith("heading"), F.when(digits == "", 1).otherwise(digits.cast("int"))).otherwise(0)
    return F.struct(kind.alias("type"), level.alias("level"))


def fidelity(asked: Column, is_pdf: Column, output: Column) -> Column:
    """the way a document is rendered: as asked, else rebuilt by place from PDF to PDF, else flowing."""
    return F.when(asked != "auto", asked).when(is_pdf & output.isin("pdf", "same"), "reconstruct").otherwise("flow")


def crop_worthy(label: Column, width: Column, height: Column) -> Column:
    """regions cropped as images; small formulas stay text."""
    return ~label.isin("formula", "formula_number") | (width >= INLINE_WIDTH) | (height >= INLINE_HEIGHT)


def too_many_pages(pages: Column) -> Column:
    """Documents beyond the page limit, which are refused."""
    return pages > MAX_PAGES


def too_many_pixels(width: Column, height: Column) -> Column:
    """Images beyond the pixel limit, which are refused."""
    return width.cast("long") * height > MAX_PIXELS


def simple_digital(pages: DataFrame) -> DataFrame:
    """(doc, simple): documents without an image and without a page of two columns, which the plain reader does well; pages: (doc, images, two)."""
    return pages.groupBy("doc").agg((~F.bool_or((F.col("images") > 0) | F.col("two"))).alias("simple"))


def weak_blocks(findings: DataFrame, blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, ord) of blocks with a hard finding, one about length, or flagged for low translation quality."""
    found = findings.where(F.col("hard") | (F.col("check") == "length")).select(by, "ord")
    return found.unionByName(blocks.where(F.array_contains("flags", "low_translation_quality")).select(by, "ord")).distinct()


def repairable(flags: Column, text: Column) -> Column:
    """Recognised text of low confidence, long enough to be mended."""
    return F.array_contains(flags, "low_ocr_confidence") & (F.length(T.strip(F.coalesce(text, F.lit("")))) >= REPAIR_CHARS)


def repaired(before: Column, after: Column) -> Column:
    """The mended text, unless it's empty, the same, or has grown too much."""
    new = T.strip(F.coalesce(after, F.lit("")))
    return F.when((new == "") | (new == T.strip(before)) | (F.length(new) > REPAIR_GROWTH * F.length(before) + REPAIR_SLACK), before).otherwise(new)


def unreliable(conf: Column) -> Column:
    """Recognised text that isn't laid over its image."""
    return F.coalesce(conf < OCR_LEAST, F.lit(False))


def needs_stronger(n: Column, mean: Column, weak: Column) -> Column:
    """Whether a page goes to a stronger recogniser: it's empty, or its mean confidence or share of weak blocks is bad."""
    return (n == 0) | (mean < WEAK_OCR) | (weak > WEAK_SHARE)


def region_style(spans: DataFrame, *by: str) -> DataFrame:
    """The size, font and colour that most characters of a region have (of equals the smallest value), bold and italic where more than half are; spans: (text, size, font, color, flags)."""
    rows = spans.withColumn("n", F.length(T.strip(F.coalesce("text", F.lit(""))))).where("n > 0").withColumn("size", F.round(F.coalesce("size", F.lit(0.0)), 1)).withColumn("font", F.coalesce(F.nullif("font", F.lit("")), F.lit("sans-serif")))
    best = None
    for name in ("size", "font", "color"):
        sums = rows.groupBy(*by, name).agg(F.sum("n").alias("k"))
        top = sums.groupBy(*by).agg(F.max("k").alias("k")).join(sums, [*by, "k"]).groupBy(*by).agg(F.min(name).alias(name))
        best = top if best is None else best.join(top, list(by))
    share = lambda bit: F.sum(F.when(F.col("flags").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(0)) * 2 > F.sum("n")
    return best.join(rows.groupBy(*by).agg(share(16).alias("bold"), share(2).alias("italic")), list(by))


def sampled(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """A24, first half: the longest translatable blocks of a document, on which engines are compared."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.length("text")), "ord"))
    return blocks.where(translatable(F.col("type"), F.col("text")) & (F.length(T.strip(F.col("text"))) >= SAMPLE_CHARS)).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_BLOCKS)


def best_engine(scores: DataFrame, by: str = "doc") -> DataFrame:
    """A24, second half: (doc, engine, mean): the engine of the best mean score, of equals the first asked (column place); unscored texts count for nothing, documents of fewer than two sampled blocks name none."""
    means = scores.where("score is not null").groupBy(by, "engine").agg(F.round(F.avg("score"), 4).alias("mean"), F.min("place").alias("place"), F.count("*").alias("n")).where("n >= 2")
    best = means.groupBy(by).agg(F.max(F.struct("mean", (-F.col("place")).alias("p"), "engine")).alias("b"))
    return best.select(by, F.col("b.engine").alias("engine"), F.col("b.mean").alias("mean"))


def estimated(source: Column, target: Column) -> Column:
    """A stand-in for a model's quality estimate that needs none: how alike the lengths are, less lost entities; null for a blank side."""
    a, b = F.length(T.strip(source)), F.length(T.strip(target))
    alike = F.least(a, b) / F.greatest(a, b)
    return F.when((a > 0) & (b > 0), alike / (F.lit(1.0) + F.size(T.missing_entities(source, target))))


def quality_annotated(blocks: DataFrame, score: Column, least: float = QE_LEAST) -> DataFrame:
    """Blocks with quality (three digits) and the flag low_translation_quality where the score is below the least; unscored ones stay as they are."""
    rows = blocks.withColumn("_score", score)
    flags = F.when(F.col("_score") < least, F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit("low_translation_quality")))).otherwise(F.col("flags"))
    return rows.withColumn("quality", F.round("_score", 3)).withColumn("flags", flags).drop("_score")


def quality_stats(rows: DataFrame, *by: str, least: float = QE_LEAST) -> DataFrame:
    """Scored blocks, their mean and least score, how many are below the bound, and how many have a flag."""
    return rows.groupBy(*by).agg(F.count("quality").alias("n"), F.avg("quality").alias("mean"), F.min("quality").alias("lowest"), F.count_if(F.col("quality") < least).alias("below"), F.count_if(F.size("flags") > 0).alias("flagged"))


FEATURES = ("spans", "bold", "italic", "colored")


def page_features(spans: DataFrame, *by: str) -> DataFrame:
    """Spans with text, and how many are bold, italic or coloured."""
    rows = spans.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(F.lit(b)) != 0)
    return rows.groupBy(*by).agg(F.count("*").alias("spans"), bit(16).alias("bold"), bit(2).alias("italic"), F.count_if(F.col("color") != 0).alias("colored"))


def features_compared(original: DataFrame, translated: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, feature, before, after, note): emphasis that is over-applied (beyond 1.5 times), mostly lost (below 0.4) or carried."""
    o, t = (d.select(by, *(F.col(c).alias(f"{p}_{c}") for c in FEATURES)) for d, p in ((original, "o"), (translated, "t")))
    both = o.join(t, by, "left").na.fill(0)
    rows = both.select(by, F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"o_{c}").alias("before"), F.col(f"t_{c}").alias("after")) for c in FEATURES))))
    ratio = F.col("after") / F.col("before")
    note = F.when((F.col("feature") == "spans") | (F.col("before") == 0), "").when(ratio > 1.5, "over-applied").when(ratio < 0.4, "mostly lost").otherwise("carried")
    return rows.withColumn("note", note)


def term_consistency(carriers: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, share): of the translations that carry a term, those that hold its own translation; 1 where that is blank. carriers: (term, tgt); terms: (term, rendering)."""
    canon = F.lower(T.strip(F.coalesce("rendering", F.lit(""))))
    rows = carriers.join(terms, "term").withColumn("hit", (canon == "") | F.lower(F.coalesce("tgt", F.lit(""))).contains(canon))
    return rows.groupBy("term").agg(F.avg(F.col("hit").cast("double")).alias("share"), F.count("*").alias("n"))


def checked_by_language(found: DataFrame, lang: str = "lang") -> DataFrame:
    """Findings by language, severity and check, with their rate among the language's pairs."""
    n = found.groupBy(lang).agg(F.count("*").alias("pairs"))
    counts = found.select(lang, F.explode("findings").alias("f")).groupBy(lang, F.col("f.hard").alias("hard"), F.col("f.check").alias("check")).agg(F.count("*").alias("n"))
    return counts.join(n, lang).withColumn("rate", F.col("n") / F.col("pairs")).drop("pairs")


def batch_jobs(view: DataFrame, batch: str) -> DataFrame:
    """The jobs of a batch by update, then id."""
    return view.where(F.col("batch_id") == batch).orderBy("updated", "job_id")


def selected_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Output pages whose source page was asked for (column source_page); without any wish all stay. wanted: (doc, first, last), open ends null."""
    asked = wanted.select("doc").distinct().withColumn("_asked", F.lit(True))
    inside = (F.col("p.doc") == F.col("w.doc")) & (F.col("p.source_page") >= F.col("w.first")) & (F.col("w.last").isNull() | (F.col("p.source_page") <= F.col("w.last")))
    rows = pages.join(asked, "doc", "left")
    kept = rows.where("_asked").drop("_asked").alias("p").join(wanted.alias("w"), inside, "left_semi")
    return kept.unionByName(rows.where("_asked is null").drop("_asked"))


def suggestion_report(suggestions: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, section): terms that a run has mined, for the user to confirm, in order."""
    line = F.concat(F.lit("- `"), "term", F.lit("` → `"), "rendering", F.lit("`"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n")
    return suggestions.groupBy(by).agg(F.concat(F.lit("## Terms found in this run\n"), lines).alias("section"))


def fuzzy_report(suggestions: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, section): past translations that were close but not reused, in order."""
    line = F.concat(F.lit("- ("), F.floor(F.col("score") * 100).cast("string"), F.lit("%) `"), "src", F.lit("`\n  - before: `"), "past_src", F.lit("` → `"), "past_tgt", F.lit("`"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n")
    return suggestions.groupBy(by).agg(F.concat(F.lit("## Close past translations\n"), lines).alias("section"))


def matrix_markdown(scores: DataFrame, engines: list[str], value: str = "score") -> DataFrame:
    """(markdown): languages by engines with the best of each row in bold (of equals the first), and how many rows each engine has won. The table has a row for each language, so it fits one row."""
    rows = scores.groupBy("lang").pivot("engine", engines).agg(F.first(value))
    top = F.greatest(*(F.coalesce(F.col(e), F.lit(float("-inf"))) for e in engines))
    winner = F.coalesce(*(F.when(F.col(e) == top, F.lit(e)) for e in engines))
    shown = [F.when(F.col(e).isNull(), "-").when(F.lit(e) == winner, F.concat(F.lit("**"), F.format_string("%.1f", F.col(e)), F.lit("**"))).otherwise(F.format_string("%.1f", F.col(e))) for e in engines]
    lines = rows.select("lang", winner.alias("winner"), F.concat(F.lit("| "), F.concat_ws(" | ", F.col("lang"), *shown), F.lit(" |")).alias("line"))
    won = F.array_join(F.array_compact(F.array(*(F.when(F.count_if(F.col("winner") == e) > 0, F.concat(F.lit(f"{e}: "), F.count_if(F.col("winner") == e).cast("string"))) for e in engines))), ", ")
    head = "| lang | " + " | ".join(engines) + " |\n|---|" + "---:|" * len(engines) + "\n"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lang", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit(head), body, F.lit("\n\nwon: "), won).alias("markdown"))


def analysis(blocks: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, payload): counts of a document and its flagged blocks as JSON, in order."""
    flag = F.size("flags") > 0
    shown = F.when(flag, F.struct("ord", F.struct((F.col("page") + 1).alias("page"), "type", "flags", "text").alias("b")))
    return blocks.groupBy(by).agg(F.to_json(F.struct(
        F.struct(F.count("*").alias("blocks"), F.count_if(flag).alias("flagged"), F.count_distinct("page").alias("pages")).alias("counts"),
        F.struct(*(F.count_if(F.array_contains("flags", name)).alias(name) for name in ("illegible", "shrunk"))).alias("rendering"),
        F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["b"]).alias("flagged"),
    )).alias("payload"))


def recognised(words: DataFrame, least: float = WEAK_OCR) -> DataFrame:
    """Blocks of a recogniser's (doc, page, ord, text, score, poly array<struct<x, y>>): blank ones go, the box is the polygon's hull, weak ones are flagged."""
    from papyrion.functions.geometry import hull

    conf = F.round("score", 3)
    rows = words.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text != ''")
    return rows.select("doc", "page", "ord", "text", hull(F.col("poly")).alias("box"), conf.alias("conf"), F.when(conf < least, F.array(F.lit("low_ocr_confidence"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def routed(pages: DataFrame, routes: DataFrame, default: list[str]) -> DataFrame:
    """Pages with the chain of recognisers for their script (routes: script, chain), the default for a script without a route. Routes are a table of some scripts."""
    return pages.join(routes, "script", "left").withColumn("chain", F.coalesce("chain", F.array(*map(F.lit, default))))


#: A script's confidence below which it is taken for noise.
SCRIPT_LEAST = 1.5


def script_language(script: Column, conf: Column, table: dict[str, str]) -> Column:
    """A recogniser's language for a page's script; null where the script is unknown or unsure."""
    known = F.create_map(*(F.lit(v) for pair in table.items() for v in pair))
    return F.when(conf >= SCRIPT_LEAST, known[script])


# Codes of an engine for Indic languages.
INDIC_CODES = {
    "en": "eng_Latn", "hi": "hin_Deva", "bn": "ben_Beng", "ta": "tam_Taml", "te": "tel_Telu", "ml": "mal_Mlym", "kn": "kan_Knda", "gu": "guj_Gujr", "pa": "pan_Guru", "mr": "mar_Deva", "or": "ory_Orya", "as": "asm_Beng",
    "ur": "urd_Arab", "ne": "npi_Deva", "si": "sin_Sinh", "sd": "snd_Arab", "ks": "kas_Arab", "sa": "san_Deva", "mai": "mai_Deva", "kok": "gom_Deva", "mni": "mni_Mtei", "doi": "doi_Deva", "brx": "brx_Deva", "sat": "sat_Olck",
}


def indic_code(lang: Column) -> Column:
    """An Indic engine's code for a language, English for others."""
    known = F.create_map(*(F.lit(v) for pair in INDIC_CODES.items() for v in pair))
    return F.coalesce(known[F.lower(F.split(lang, "-")[0])], F.lit(INDIC_CODES["en"]))


def indic_direction(source: Column, target: Column) -> Column:
    """the family of models that translates between two codes."""
    english = INDIC_CODES["en"]
    return F.when((source != english) & (target != english), "indic-indic").when(source != english, "indic-en").otherwise("en-indic")


GRAMS, PROFILE = 3, 300


def _pair(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def grams(x: Column) -> Column:
    """Distinct runs of three characters of a text in lower case, each word with a space around it."""
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+"), F.lit(0)), " "), F.lit(" "))
    # by single characters, as a place in a text is found by counting from its start
    chars = F.split(padded, "")
    runs = lambda c: F.array_distinct(F.zip_with(F.zip_with(c, F.slice(c, 2, F.size(c)), _pair), F.slice(c, 3, F.size(c)), _pair))
    return F.filter(T.with_value(chars, runs), lambda g: F.length(g) == GRAMS)


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """F47, first half: (lang, gram, weight): the commonest character runs of each language, heaviest first; ties by gram."""
    from pyspark.sql import Window

    counts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.explode(grams(F.col(text))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "gram", (PROFILE + 1 - F.col("rank")).alias("weight"))


def language_of(docs: DataFrame, profiles: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred): the language whose profile weighs most in a text's character runs, the first of equals; a text without letters has none. Profiles are a table of a fixed number of rows for each language."""
    rows = docs.where(F.col(text).rlike(r"\p{L}")).select(by, F.explode(grams(F.col(text))).alias("gram"))
    sums = rows.join(profiles, "gram").groupBy(by, "lang").agg(F.sum("weight").alias("w"))
    top = sums.groupBy(by).agg(F.max("w").alias("w")).join(sums, [by, "w"]).groupBy(by).agg(F.min("lang").alias("lang_pred"))
    return docs.select(by).distinct().join(top, by, "left")


def box_fidelity(source: DataFrame, output: DataFrame) -> DataFrame:
    """(doc, biou, coverage, n): how well an output keeps a source's boxes: those of a page, in shares of its size, matched one to one by IoU; a source box without a match counts 0. Rows: (doc, page, ord, x0..y1, width, height)."""
    share = lambda d: d.select(*PAGE, "ord", *((F.col(c) / F.col("width")).alias(c) for c in ("x0", "x1")), *((F.col(c) / F.col("height")).alias(c) for c in ("y0", "y1")))

    def run(rows: pa.Table, page: np.ndarray) -> pa.Table:
        a, _, iou = matches(rows, page)
        own = np.bincount(page, ~rows.column("second").to_numpy()).astype(np.int64)
        first = np.searchsorted(page, np.arange(len(own)))
        sums = np.bincount(page[a], iou, len(own)), np.bincount(page[a], minlength=len(own)).astype(np.int64), own
        return pa.Table.from_arrays([rows.column("doc").take(first), *map(pa.array, sums)], ["doc", "iou", "matched", "n"])

    pages = whole_pages(sides(share(source), share(output)), run, f"doc {source.schema['doc'].dataType.simpleString()}, iou double, matched bigint, n bigint")
    out = pages.groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("iou", "matched", "n"))).where("n > 0")
    return out.select("doc", (100 * F.col("iou") / F.col("n")).alias("biou"), (F.col("matched") / F.col("n")).alias("coverage"), "n")


CALL_CELLS = 16_384


def placed_cells(cells: DataFrame, *by: str) -> DataFrame:
    """Cells (row, ord, rowspan, colspan, text) of a table with the column of the next free slot of their row, and a blank row for each slot that a merged cell also covers."""

    def run(tables: pd.DataFrame) -> pd.DataFrame:
        taken: set[tuple] = set()
        out = []
        for c in tables.sort_values([*by, "row", "ord"]).itertuples(index=False):
            table, column = tuple(getattr(c, b) for b in by), 0
            while (table, c.row, column) in taken:
                column += 1
            for dy in range(max(1, c.rowspan)):
                for dx in range(max(1, c.colspan)):
                    taken.add((table, c.row + dy, column + dx))
                    out.append((*table, c.row + dy, column + dx, c.text if dy == dx == 0 else "", dy == dx == 0))
        return pd.DataFrame(out, columns=[*by, "row", "col", "text", "anchor"])

    kinds = ", ".join(f"{b} {cells.schema[b].dataType.simpleString()}" for b in by)
    # many small tables in a call, whole ones each
    calls = max(1, -(-cells.count() // CALL_CELLS))
    rows = cells.select(*by, "row", "ord", "rowspan", "colspan", "text").withColumn("_call", F.pmod(F.xxhash64(*by), F.lit(calls)))
    return rows.groupBy("_call").applyInPandas(run, f"{kinds}, row int, col int, text string, anchor boolean")


#: Versions of the stores' schema: what each adds to the one before, by table.
SCHEMA_STEPS: tuple[dict[str, dict[str, str]], ...] = (
    {"tm": {"confirmed": "false", "origin": "'engine'"}},
    {"tm": {"domain": "''"}, "glossary": {"domain": "''", "locked": "false"}},
    {"tm": {"ctx": "''"}},
)


def upgraded(rows: DataFrame, table: str, version: int) -> DataFrame:
    """A store's table of an older schema version with the columns that later ones have added; columns that are there stay."""
    for step in SCHEMA_STEPS[version - 1 :]:
        for name, default in step.get(table, {}).items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.expr(default))
    return rows


class Stages:
    """Seconds by stage of a run on the driver, added up where a stage comes again."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
