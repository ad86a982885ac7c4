"""Subtitles, memories and glossaries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import text as T


def cues(files: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, n, id, header, body, is_cue): blocks between blank lines; the header runs through the line with an arrow, a block without one is all header. n counts all blocks."""
    whole = F.replace(text_col, F.lit("\r\n"), F.lit("\n"))
    parts = F.filter(F.transform(F.split(whole, "\n\n"), lambda b: F.regexp_replace(b, "^\n+|\n+$", "")), lambda b: T.strip(b) != "")
    rows = files.select(F.col(id_col), F.posexplode(parts).alias("n", "block")).withColumn("lines", F.split("block", "\n", -1))
    at = F.aggregate("lines", F.struct(F.lit(0).alias("i"), F.lit(0).alias("hit")), lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when((s["hit"] == 0) & x.contains("-->"), s["i"] + 1).otherwise(s["hit"]).alias("hit")))["hit"]
    rows = rows.withColumn("at", at)
    header = F.when(F.col("at") == 0, F.col("block")).otherwise(F.array_join(F.slice("lines", 1, F.greatest("at", F.lit(1))), "\n"))
    body = F.when(F.col("at") == 0, "").otherwise(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), "\n"))
    return rows.select(id_col, "n", F.concat(F.lit("cue"), "n").alias("id"), header.alias("header"), body.alias("body"), (F.col("at") > 0).alias("is_cue"))


def composed(rows: DataFrame, id_col: str = "path", body: Column | None = None) -> DataFrame:
    """The file again, headers as they were, bodies as given."""
    text = F.col("body") if body is None else body
    one = F.when(~F.col("is_cue"), F.col("header")).when(text == "", F.col("header")).otherwise(F.concat(F.col("header"), F.lit("\n"), text))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"])
    return rows.groupBy(id_col).agg(F.concat(F.array_join(parts, "\n\n"), F.lit("\n")).alias("text"))


def translation_units(spark: SparkSession, path: str) -> DataFrame:
    """(src_lang, src, tgt_lang, tgt) of a TMX file's units, the first two variants of each; blank ones go."""
    schema = "tuv array<struct<_lang:string,`_xml:lang`:string,seg:string>>"
    rows = spark.read.format("xml").option("rowTag", "tu").schema(schema).load(path).where(F.size("tuv") >= 2)
    lang = lambda i: F.lower(F.coalesce(F.col("tuv")[i]["_xml:lang"], F.col("tuv")[i]["_lang"]))
    out = rows.select(lang(0).alias("src_lang"), F.col("tuv")[0]["seg"].alias("src"), lang(1).alias("tgt_lang"), F.col("tuv")[1]["seg"].alias("tgt"))
    return out.where((T.strip(F.coalesce("src", F.lit(""))) != "") & (T.strip(F.coalesce("tgt", F.lit(""))) != ""))


def unit_markup(src: Column, tgt: Column, src_lang: str, tgt_lang: str) -> Column:
    """A translation unit as TMX markup."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = lambda lang, x: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), safe(x), F.lit("</seg></tuv>"))
    return F.concat(F.lit("<tu>"), one(src_lang, src), one(tgt_lang, tgt), F.lit("</tu>"))


def glossary_csv(spark: SparkSession, path: str, src_lang: str = "", tgt_lang: str = "", domain: str = "") -> DataFrame:
    """Glossary rows of a CSV file with columns source, target and optional languages and domain that override the arguments; a header is optional, a byte order mark allowed."""
    names = ("term", "rendering", "src_lang", "tgt_lang", "domain")
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", "false").csv(path)
    rows = rows.withColumn("term", F.regexp_replace("term", "^\ufeff", "")).where("not (lower(term) = 'source' and lower(rendering) = 'target')")
    given = {"src_lang": src_lang, "tgt_lang": tgt_lang, "domain": domain}
    rows = rows.withColumns({k: F.coalesce(F.nullif(F.trim(k), F.lit("")), F.lit(v)) for k, v in given.items()})
    return rows.where((T.strip(F.coalesce("term", F.lit(""))) != "") & (T.strip(F.coalesce("rendering", F.lit(""))) != ""))


def glossary_json(rows: DataFrame, json: str = "json") -> DataFrame:
    """(term, rendering) of JSON objects, without blank ones."""
    entries = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: (T.strip(k) != "") & (T.strip(F.coalesce(v, F.lit(""))) != ""))
    return rows.select(F.explode(entries).alias("term", "rendering"))


def review_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a review file."""
    return spark.read.option("sep", "\t").option("header", "true").csv(path)


ENTRY = ("src_lang", "tgt_lang", "domain", "term", "rendering", "origin", "locked")


def _entries(rows: DataFrame) -> DataFrame:
    """Glossary entries of rows that may lack columns: without those that lack a term, rendering or language; locked is 1 or true."""
    for name in ENTRY:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    text = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)).alias(c)
    out = rows.select("src_lang", "tgt_lang", text("domain", ""), "term", "rendering", text("origin", "user"), F.coalesce(F.lower(F.col("locked").cast("string")).isin("1", "true"), F.lit(False)).alias("locked"))
    return out.where(" and ".join(f"coalesce({c}, '') != ''" for c in ("term", "rendering", "src_lang", "tgt_lang")))


def glossary_entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entries of a `tsv` (with a header, columns in any order) or `json` file (a list of objects, or an object a line). A JSON file is read whole, as its list may span lines."""
    if kind == "tsv":
        return _entries(spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path))
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v")).where("v != ''")
    as_list = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.concat(F.lit("["), F.array_join(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), ","), F.lit("]")))
    return _entries(whole.select(F.inline(F.from_json(as_list, f"array<struct<{','.join(f'{c}:string' for c in ENTRY)}>>"))))


def write_glossary(entries: DataFrame, path: str, kind: str) -> None:
    """Entries as `csv` (source, target, languages, domain), `tsv` or `json` lines, in order; what a spreadsheet would run as a formula is quoted in the first two."""
    rows = entries.orderBy("src_lang", "tgt_lang", "domain", "term")
    if kind == "json":
        rows.select(*ENTRY).write.mode("overwrite").json(path)
    elif kind == "csv":
        names = {"term": "source", "rendering": "target", "src_lang": "src_lang", "tgt_lang": "tgt_lang", "domain": "domain"}
        rows.select(*(T.spreadsheet_safe(F.col(c)).alias(n) for c, n in names.items())).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)
    else:
        safe = [T.spreadsheet_safe(F.col(c)).alias(c) if c in ("term", "rendering") else F.col(c) for c in ENTRY]
        rows.select(*safe).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(path)


def write_review(segments: DataFrame, path: str) -> None:
    """The review file of segments (block_id, source, translation) with an empty column for corrections."""
    segments.select("block_id", "source", "translation", F.lit("").alias("correction")).write.mode("overwrite").option("sep", "\t").option("header", "true").option("emptyValue", "").csv(path)


def append_history(records: DataFrame, path: str) -> None:
    """Score records added to a history of JSON lines."""
    records.write.mode("append").json(path)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records of a history, by date; lines that aren't JSON count for nothing."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy("date")
