"""Scalar text functions as Column expressions; each takes and returns Columns and stays inside the JVM unless it says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"
_EDGE = r"(?U)^\s+|\s+$"

# Ligatures and what they stand for; characters without width; mathematical operators.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
WIDTHLESS = "\u00ad\u200b\ufeff"
MATH_OPERATORS = "=<>≤≥≠≈∈∉⊂⊆∪∩∑∏∫√∂∇∞∼≅≡↦→⊕⊗±×÷·"
CJK = r"\u3000-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef"
RTL_LANGUAGES = ("ar", "fa", "he", "ur", "yi", "ps", "sd", "ug", "dv", "ckb")
RTL_CLASS = r"\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}"


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, _EDGE, "")


def collapsed(x: Column) -> Column:
    return F.regexp_replace(strip(x), _SPACE, " ")


def memory_key(x: Column) -> Column:
    """the key of a translation memory, and of headers."""
    return F.lower(collapsed(x))


def consistency_key(x: Column) -> Column:
    """case folded through upper case, so ß meets ss."""
    return F.replace(F.lower(F.upper(collapsed(x))), F.lit("ß"), F.lit("ss"))


def repetition_key(x: Column) -> Column:
    """letters only; digits and marks become one space."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}_]+|_+", " "))


def furniture_key(x: Column) -> Column:
    """digit runs become #, so page numbers meet."""
    return F.regexp_replace(F.lower(collapsed(x)), r"\p{Nd}+", "#")


def dehyphenated(x: Column) -> Column:
    """F8: a word parted by a hyphen and space between lower-case letters is one word again."""
    return F.regexp_replace(x, "(?<=[a-zà-öø-ÿ])-(?U:\\s+)(?=[a-zà-öø-ÿ])", "")


def cleaned(x: Column) -> Column:
    """F6 but for composition (:func:`composed`): line-end hyphens, characters without width, ligatures, gaps in CJK."""
    x = F.regexp_replace(x, "(?<=\\p{L})[-\u00ad](?:\n(?=\\p{L})|[ \t]+(?=[a-z]))", "")
    x = F.translate(x, WIDTHLESS, "")
    for joined, apart in LIGATURES.items():
        x = F.replace(x, F.lit(joined), F.lit(apart))
    return F.regexp_replace(x, f"(?<=[{CJK}])[ \t]+(?=[{CJK}0-9])|(?<=[0-9])[ \t]+(?=[{CJK}])", "")


def composed(x: Column) -> Column:
    """Unicode composition (NFC), which has no built-in function: an Arrow-batched function for texts that aren't ASCII."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(F.pandas_udf(_nfc, "string")(x))


def garbage(x: Column) -> Column:
    """20 characters or more, with a glyph placeholder or a tenth of control, private, unassigned or replacement characters."""
    odd = F.regexp_count(x, F.lit("[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cs}\\p{Cn}\ufffd&&[^\t\n\r]]"))
    return (F.length(x) >= 20) & (x.rlike(r"\(cid:\d+\)") | (odd > 0.1 * F.length(x)))


def formula_line(x: Column) -> Column:
    """at most 200 characters with a mathematical operator, at most six long words and three lone letters or more."""
    s = strip(x)
    lone = F.regexp_count(s, F.lit(r"(?<!\p{L})\p{L}(?!\p{L})"))
    return (F.length(s) > 0) & (F.length(s) <= 200) & s.rlike(f"[{MATH_OPERATORS}]") & (F.regexp_count(s, F.lit("[A-Za-z]{4,}")) <= 6) & (lone >= 3)


def tabular_line(x: Column) -> Column:
    """eight tokens or more, of which six and over 35 % are numeric."""
    tokens = F.filter(F.split(x, _SPACE), lambda t: t != "")
    numeric = F.size(F.filter(tokens, lambda t: t.rlike(r"^[-+(]?[$€£]?[0-9][0-9.,]*[%)]?$")))
    return (F.size(tokens) >= 8) & (numeric >= 6) & (numeric > 0.35 * F.size(tokens))


ROMAN = "m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"


def page_number(x: Column) -> Column:
    """at most 12 characters that are a number, `page n`, `n of m`, or a Roman number in one case."""
    s = strip(x)
    number = s.rlike(r"(?i)^(page\s+)?\p{Nd}+(\s*[/of-]+\s*\p{Nd}+)?\.?$")
    return (F.length(s) > 0) & (F.length(s) <= 12) & (number | s.rlike(f"^{ROMAN}$") | s.rlike(f"^{ROMAN.upper()}$"))


def rtl_language(lang: Column) -> Column:
    return F.coalesce(F.lower(F.split(F.replace(lang, F.lit("_"), F.lit("-")), "-")[0]).isin(*RTL_LANGUAGES), F.lit(False))


def rtl_ratio(x: Column) -> Column:
    """right-to-left letters among all letters; 0 without any."""
    right, letters = F.regexp_count(x, F.lit(f"[{RTL_CLASS}&&\\p{{L}}]")), F.regexp_count(x, F.lit(r"\p{L}"))
    return F.when(letters > 0, right / letters).otherwise(F.lit(0.0))


def rtl_text(x: Column) -> Column:
    return rtl_ratio(x) >= 0.4


def mixed_direction(x: Column) -> Column:
    return x.rlike(f"[{RTL_CLASS}&&\\p{{L}}]") & x.rlike(r"\p{IsLatin}")


def direction(x: Column, lang: Column) -> Column:
    """the text's own direction where it has strong letters, else the language's."""
    return F.when(x.rlike(r"\p{L}"), F.when(rtl_text(x), "rtl").otherwise("ltr")).otherwise(F.when(rtl_language(lang), "rtl").otherwise("ltr"))


#: Scripts that are told apart, by the name of their Unicode script.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Han", "Hiragana", "Katakana", "Hangul")
#: Scripts of languages that aren't written in Latin letters.
LANGUAGE_SCRIPTS = {
    "ru": "Cyrillic", "uk": "Cyrillic", "bg": "Cyrillic", "sr": "Cyrillic", "mk": "Cyrillic", "be": "Cyrillic", "kk": "Cyrillic", "el": "Greek",
    "ar": "Arabic", "fa": "Arabic", "ur": "Arabic", "he": "Hebrew", "yi": "Hebrew", "hi": "Devanagari", "mr": "Devanagari", "ne": "Devanagari", "bn": "Bengali",
    "as": "Bengali", "th": "Thai", "zh": "Han", "ja": "Han", "ko": "Hangul",
}


def script_counts(x: Column) -> dict[str, Column]:
    """X23 for texts: letters of each script."""
    return {s: F.regexp_count(x, F.lit(f"\\p{{Is{s}}}")) for s in SCRIPTS}


def script_of_language(lang: Column) -> Column:
    """the script of a language code, Latin unless it's known to be another."""
    table = F.create_map(*(F.lit(v) for pair in LANGUAGE_SCRIPTS.items() for v in pair))
    return F.coalesce(table[F.lower(F.split(lang, "[-_]")[0])], F.lit("Latin"))


def cross_script(source: Column, target: Column) -> Column:
    """whether a translation changes the script; false where the source is unknown."""
    return F.coalesce(script_of_language(source) != script_of_language(target), F.lit(False))


def untranslated(source: Column, target: Column) -> Column:
    """F32: equal but for edge space, with three words of four letters or more."""
    return (strip(source) == strip(target)) & (F.regexp_count(source, F.lit(r"\p{L}{4,}")) >= 3)


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, r"\P{Nd}", "")


# Patterns of entities that a translation keeps.
NUMBER = r"\d[\d.,]*\d|\d"
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def with_value(value: Column, use) -> Column:
    """use(value) with the value evaluated once, however often use names it: a lambda's variable holds it."""
    return F.transform(F.array(value), use)[0]


def missing_entities(source: Column, target: Column) -> Column:
    """numbers (by digits alone), URLs and addresses of the source that the target lacks, in order, with repeats.

    A hash-based set difference finds what is lost; the source is looked through for it only where something is.
    """
    return F.concat(_lost(source, target, NUMBER, digits_only), _lost(source, target, URL, lambda m: m), _lost(source, target, EMAIL, lambda m: m))


def _lost(source: Column, target: Column, pattern: str, key) -> Column:
    """The source's matches whose key no match of the target has."""
    found = lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    own = F.transform(found(source), lambda m: F.struct(m.alias("m"), key(m).alias("k")))
    both = F.struct(own.alias("own"), F.transform(found(target), key).alias("there"))
    gone = lambda v: F.struct(v["own"].alias("own"), F.array_except(v["own"]["k"], v["there"]).alias("gone"))
    kept = lambda v: F.when(F.size(v["gone"]) == 0, F.array().cast("array<string>")).otherwise(F.filter(v["own"], lambda x: F.array_contains(v["gone"], x["k"]))["m"])
    return with_value(both, lambda v: with_value(gone(v), kept))


# Bounds of target length over source length, by target language; else GENERIC_BAND.
LENGTH_BANDS = {"zh": (0.2, 1.1), "ja": (0.2, 1.3), "ko": (0.2, 1.3), "th": (0.3, 1.3), "de": (0.7, 2.2), "fi": (0.7, 2.3), "ru": (0.7, 2.2), "ar": (0.6, 2.0), "hu": (0.7, 2.2), "nl": (0.8, 2.0)}
GENERIC_BAND = (0.5, 2.0)
MIN_BAND_CHARS = 25


def length_band(lang: Column) -> Column:
    """struct (low, high) for a target language."""
    key = F.lower(F.split(F.coalesce(lang, F.lit("")), "-")[0])
    bound = lambda i: F.coalesce(F.create_map(*(F.lit(v) for k, b in LENGTH_BANDS.items() for v in (k, b[i])))[key], F.lit(GENERIC_BAND[i]))
    return F.struct(bound(0).alias("low"), bound(1).alias("high"))


def outside_band(source: Column, target: Column, lang: Column) -> Column:
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    band = length_band(lang)
    return (F.length(source) >= MIN_BAND_CHARS) & ~ratio.between(band["low"], band["high"])


def continues(first: Column, second: Column) -> Column:
    """whether a paragraph goes on: after a hyphen yes, after an end mark no, else if the next starts low, with a digit or mid-sentence."""
    a, b = F.regexp_replace(first, r"(?U)\s+$", ""), F.regexp_replace(second, r"(?U)^\s+", "")
    return F.when((F.length(a) == 0) | (F.length(b) == 0), False).when(a.endswith("-"), True).when(a.rlike("[.!?:;。！？…\"'”’)\\]]$"), False).otherwise(b.rlike(r"^[\p{Ll}\p{Nd}(,;:]"))


def joined(first: Column, second: Column) -> Column:
    """two parts of a paragraph as one; a hyphen between lower-case letters goes."""
    a, b = F.regexp_replace(first, r"(?U)\s+$", ""), F.regexp_replace(second, r"(?U)^\s+", "")
    return F.when(a.rlike(r"\p{Ll}-$") & b.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, F.lit(" "), b))


def spreadsheet_safe(x: Column) -> Column:
    """A value that a spreadsheet would run as a formula gets a quote first."""
    return F.when(F.substring(x, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), x)).otherwise(x)


def edge_space(source: Column, target: Column) -> Column:
    """the target with the source's white space at its ends."""
    return F.concat(F.regexp_extract(source, r"(?U)^\s*", 0), strip(target), F.when(source.rlike(r"(?U)^\s*$"), "").otherwise(F.regexp_extract(source, r"(?U)\s*$", 0)))


# Languages that write decimals with a comma; a grouped number, and a plain decimal.
COMMA_DECIMAL = ("id", "de", "es", "fr", "it", "pt", "nl", "ru", "tr", "pl", "uk", "cs", "da", "fi", "sv", "nb", "no", "ro", "hu", "el", "vi", "hr", "sk", "sl", "lt", "lv", "et")
GROUPED = r"(?<![\d.,])\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\d.,])"
DECIMAL = r"(?<![\d.,])\d+\.\d+(?![\d.,eE])"


def localized_numbers(x: Column, lang: Column) -> Column:
    """grouped numbers and decimals with their comma and dot changed over. A single group without decimals ends as it was, since it then reads as a decimal and is changed back."""
    applies = F.lower(F.split(F.coalesce(lang, F.lit("")), "-")[0]).isin(*COMMA_DECIMAL)

    def swapped(text: Column, pattern: str, change) -> Column:
        mark = "\ue000"
        parts = F.split(F.regexp_replace(text, f"({pattern})", f"{mark}$1{mark}"), mark, -1)
        return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, change(p)).otherwise(p)), "")

    once = swapped(x, GROUPED, lambda p: F.translate(p, ",.", ".,"))
    return F.when(applies, swapped(once, DECIMAL, lambda p: F.replace(p, F.lit("."), F.lit(",")))).otherwise(x)


def expanded(x: Column, factor: float) -> Column:
    """a text of about factor times as many words, by repeating them."""
    words = F.filter(F.split(x, _SPACE), lambda w: w != "")
    want = F.ceil(F.size(words) * F.lit(factor)).cast("int")
    return F.when(F.size(words) == 0, x).otherwise(F.array_join(F.slice(F.flatten(F.array_repeat(words, int(factor) + 1)), 1, F.greatest(want, F.lit(1))), " "))


def pages_wanted(spec: Column) -> Column:
    """Zero-based (first, last) spans of a page list such as `3-7,10,15-`; last is null for open ends; malformed parts go."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: p.rlike("^[0-9]+(-[0-9]*)?$"))

    def span(p: Column) -> Column:
        first = F.split(p, "-")[0].cast("int") - 1
        last = F.when(~p.contains("-"), first).when(p.endswith("-"), F.lit(None).cast("int")).otherwise(F.element_at(F.split(p, "-"), -1).try_cast("int") - 1)
        return F.struct(F.greatest(first, F.lit(0)).alias("first"), last.alias("last"))

    return F.transform(good, span)


def marker_count(x: Column, markers: list[str]) -> Column:
    """words of the text that are in a list of a language's commonest words."""
    words = F.split(F.lower(x), r"[^\p{L}]+")
    return F.size(F.filter(words, lambda w: w.isin(*markers)))
