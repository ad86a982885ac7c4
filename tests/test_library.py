"""The library's own operators on small fixtures."""

from __future__ import annotations

import difflib
import io
import math
import random
import re
import zipfile
from xml.etree import ElementTree

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrion.functions import geometry as G
from papyrion.functions import metrics as X
from papyrion.functions import protect as P
from papyrion.functions import text as T
from papyrion.operators import engines as E
from papyrion.operators import layout as L
from papyrion.operators import memory as M
from papyrion.operators import pages
from papyrion.operators import scoring as C
from papyrion.operators import segments as S
from papyrion.plans import layout_queries as LQ
from papyrion.plans import text_queries as Q
from papyrion.sinks import archives, render
from papyrion.sources import containers
from papyrion.sources import containers as K
from papyrion.sources import tables as B
from papyrion.streaming import stores


def value(spark, column, **inputs):
    return spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in inputs.items())).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    """Columns a and b, which need a session."""
    globals().update(a=F.col("a"), b=F.col("b"))


@pytest.mark.parametrize(
    ("column", "inputs", "want"),
    [
        (lambda: T.memory_key(a), {"a": "  Ab\t C\n"}, "ab c"),
        (lambda: T.consistency_key(a), {"a": "STRAßE"}, "strasse"),
        (lambda: T.repetition_key(a), {"a": "Page 12 — of_9"}, "page of"),
        (lambda: T.furniture_key(a), {"a": " Page  12 of 34"}, "page # of #"),
        (lambda: T.dehyphenated(a), {"a": "exam- ple A-\nb"}, "example A-\nb"),
        (lambda: T.cleaned(a), {"a": "con-\ntent o­ne ﬁn 漢 字"}, "content one fin 漢字"),
        (lambda: T.composed(a), {"a": "é"}, "é"),
        (lambda: T.page_number(a), {"a": "Page 3 of 9"}, True),
        (lambda: T.page_number(a), {"a": "xiv"}, True),
        (lambda: T.page_number(a), {"a": "Xiv"}, False),
        (lambda: T.formula_line(a), {"a": "a + b = c"}, True),
        (lambda: T.formula_line(a), {"a": "This plain sentence has no operator"}, False),
        (lambda: T.tabular_line(a), {"a": "1 2 3 4 5 6 x y"}, True),
        (lambda: T.garbage(a), {"a": "���" + "x" * 20}, True),
        (lambda: T.rtl_text(a), {"a": "שלום abc"}, True),
        (lambda: T.untranslated(a, b), {"a": "three longer words", "b": " three longer words "}, True),
        (lambda: F.array_join(T.missing_entities(a, b), "|"), {"a": "2,600 from me@own.test, 31 and 31", "b": "2.600"}, "31|31|me@own.test"),
        (lambda: T.outside_band(a, b, F.lit("zh-CN")), {"a": "x" * 30, "b": "y" * 9}, False),
        (lambda: T.outside_band(a, b, F.lit("fr")), {"a": "x" * 30, "b": "y" * 9}, True),
        (lambda: T.continues(a, b), {"a": "ends here.", "b": "next"}, False),
        (lambda: T.continues(a, b), {"a": "goes on", "b": "next"}, True),
        (lambda: T.joined(a, b), {"a": "exam-", "b": "ple"}, "example"),
        (lambda: T.spreadsheet_safe(a), {"a": "=1+1"}, "'=1+1"),
        (lambda: T.localized_numbers(a, F.lit("id")), {"a": "about 7,305.25 or 48.75"}, "about 7.305,25 or 48,75"),
        (lambda: T.localized_numbers(a, F.lit("id")), {"a": "8,020 or 8,020,411"}, "8,020 or 8.020.411"),
        (lambda: T.localized_numbers(a, F.lit("de")), {"a": "build 4.0.17 at 2.5e-3"}, "build 4.0.17 at 2.5e-3"),
        (lambda: T.localized_numbers(a, F.lit("en")), {"a": "7,305.25"}, "7,305.25"),
        (lambda: T.edge_space(a, b), {"a": "  x ", "b": "y"}, "  y "),
        (lambda: T.expanded(a, 1.5), {"a": "one two"}, "one two one"),
        (lambda: T.script_of_language(a), {"a": "ru-RU"}, "Cyrillic"),
        (lambda: X.error_rate(a, b), {"a": "hello", "b": "hallo"}, 0.2),
        (lambda: X.error_rate(a, b), {"a": "", "b": "x"}, 1.0),
        (lambda: X.word_error_rate(a, b), {"a": "one two three", "b": "one too three"}, 1 / 3),
        (lambda: X.word_error_rate(a, b), {"a": "", "b": ""}, 0.0),
        (lambda: X.chrf(a, b), {"a": "same text", "b": "same text"}, 100.0),
        (lambda: X.chrf(a, b), {"a": "", "b": ""}, 0.0),
        (lambda: X.lexical_ratio(a, b), {"a": "abcd", "b": "bcde"}, 0.75),
        (lambda: P.enforced(a, {"Rev": "Put", "Revenue": "Einnahmen"}), {"a": "Revenue Rev http://Rev.x"}, "Einnahmen Put http://Rev.x"),
        (lambda: render.output_name(a, F.lit("docx"), F.lit("de")), {"a": "x/report.v1.pdf"}, "x/report.v1.de.docx"),
    ],
)
def test_columns(spark, column, inputs, want):
    got = value(spark, column(), **inputs)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_page_spans(spark):
    got = value(spark, F.transform(T.pages_wanted(a), lambda s: F.concat_ws(":", s["first"], s["last"])), a="3-7, 10,15-,x,4-z")
    assert got == ["2:6", "9:9", "14"]


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_masking_is_reversible(text):
    masked, meant = P.mask(text)
    assert P.unmask(masked, meant) == text


def test_masking_cases():
    assert P.mask("see [PH0] and a@b.com")[0] == "see [PH0] and [PH1]"
    assert P.unmask("x [ PH0 ] [PH7]", {0: "y"}) == "x y "
    assert P.unmask("[PH0]", {}) == "[PH0]"
    assert len(P.mask("costs $5 and $10")[1]) == 2
    assert P.mask("Revenue", ["Rev"])[1] == {} and P.mask("这是中文文本", ["中文"])[1] == {0: "中文"}
    assert P.same_protected("1.2.3 then a@b.cc", "a@b.cc then 1.2.3")
    assert "".join(P.cut("One two. Three four five six", 12)) == "One two. Three four five six" and max(map(len, P.cut("x" * 50, 12))) == 12


def box(*v):
    return F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))


def test_geometry(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(G.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert get(G.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0
    assert get(G.contained(box(0, 0, 10, 10), box(0, 0, 10, 7))) and get(G.same_column(box(0, 0, 10, 1), box(5, 9, 30, 10)))
    assert get(G.vertical(box(0, 0, 10, 50))) and get(G.dominated(F.lit(0.7), F.lit(10)))


def test_xy_cut():
    order = lambda *boxes: L.xy_cut(np.array(boxes, float), 600, 800)
    assert order((0, 0, 400, 50), (450, 0, 600, 40), (0, 60, 400, 90), (450, 60, 600, 90)) == [0, 2, 1, 3]
    assert order((0, 0, 600, 40), (0, 100, 280, 140), (320, 100, 600, 140), (0, 200, 280, 240), (320, 200, 600, 240)) == [0, 1, 3, 2, 4]
    assert order() == [] and order((0, 0, 1, 1)) == [0]


def test_greedy_columns_reflow_chains_and_packing():
    assert L.greedy([(0, 0, 0.5), (0, 1, 0.9), (1, 1, 0.8), (1, 0, 0.2)]) == [(0, 1, 0.9), (1, 0, 0.2)]
    assert L.column_clusters(np.array([(0, 0, 100, 1), (200, 0, 300, 1), (10, 5, 90, 6)], float)) == [0, 1, 0]
    assert L.reflow([50.0, 100.0], [40.0, 40.0], [80.0, 40.0], 200.0) == [(0, 50.0), (1, 36.0)]
    boxes = np.array([(0, 0, 100, 10), (0, 20, 100, 30), (300, 0, 400, 10)], float)
    assert L.chains(boxes, ["goes on", "here.", "other"], L.goes_on) == [0, 0, 1]
    assert E.packed([3, 4, 9, 1, 1], 7) == [0, 0, 1, 2, 2]


def test_memory_log(spark):
    rows = [(1, "A", "a1"), (2, "a ", "a2"), (3, "b", "b1"), (9, " ", "x")]
    pairs = spark.createDataFrame(rows, "seq long, src string, tgt string")
    events = M.puts(pairs, "seq", "de")
    events = events.unionByName(M.puts(pairs.where("seq = 3").withColumn("seq", F.lit(4)), "seq", "de", kind="confirm")).unionByName(M.puts(pairs.where("seq = 3").withColumn("seq", F.lit(5)).withColumn("tgt", F.lit("late")), "seq", "de"))
    view = {r["norm"]: (r["tgt_text"], r["confirmed"]) for r in M.memory(events).collect()}
    assert view == {"a": ("a2", False), "b": ("b1", True)}
    fixed = M.puts(pairs.where("seq = 3").withColumn("seq", F.lit(6)).withColumn("tgt", F.lit("fixed")), "seq", "de", kind="correction")
    assert {r["norm"]: r["tgt_text"] for r in M.memory(events.unionByName(fixed)).collect()}["b"] == "fixed"
    assert M.stats(M.memory(events)).first()[:] == (2, 1, 1) and M.purged(M.memory(events)).count() == 1


def test_consistency_and_terms(spark):
    rows = spark.createDataFrame([(1, "X y", "A"), (2, "x  Y", "B"), (3, "x y", "A"), (4, "z", "C"), (5, "z", "D")], "at long, line string, tgt string")
    assert {r["key"]: r["target"] for r in S.majority(rows, T.consistency_key(F.col("line")), "tgt", "at").collect()} == {"x y": "A", "z": "C"}
    docs = spark.createDataFrame([("Use NASA and Foo. Foo ran. NASA won. Bar bar Bar. New York New York",)], "text string")
    assert {(r["term"], r["kind"]) for r in S.mined_terms(docs).collect()} == {("NASA", "acronym"), ("Foo", "name")}


def test_consistency_and_terms_over_all_lines(spark, tmp_path):
    docs = [(1, "Straße ä\nSTRASSE  Ä\nplain", "de"), (2, "straße Ä\nPlain", "de"), (3, "NASA’s “Foo” won. NASA and Foo", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    own = lambda name: Q.QUERIES[name](spark, str(tmp_path)).collect()
    want, seen = {}, {}
    for d, text, _ in docs:
        for o, line in enumerate(text.split("\n")):
            key = " ".join(line.split()).upper().lower().replace("ß", "ss")
            want[key] = want.get(key, 0) + 1
            seen.setdefault(key, []).append(line.upper() if (d + o) % 3 == 0 else line)
    assert {r["key"]: r["n"] for r in own("norm_consistency_key")} == want
    assert {r["key"]: (r["target"], r["n"]) for r in own("consistency_majority")} == {k: (max(dict.fromkeys(v), key=v.count), len(v)) for k, v in seen.items()}
    assert {(r["term"], r["kind"], r["n"]) for r in own("auto_glossary")} == {("NASA", "acronym", 2), ("Foo", "name", 2)}


def test_breaker_and_escalation(spark):
    rows = spark.createDataFrame([(i, "e", f) for i, f in enumerate([True, True, False, True])], "at long, engine string, f boolean")
    assert [r["tripped"] for r in C.breaker(rows, "engine", "at", F.col("f")).orderBy("at").collect()] == [False, True, False, False]
    assert stores.stepped(1, None, True, 5.0) == (2, 5.0) and stores.stepped(2, 5.0, True, 99.0) == (3, 99.0) and stores.stepped(3, 5.0, False, 9.0) == (0, None)
    passes = spark.createDataFrame([("d", 0, 0.3), ("d", 1, 0.35), ("d", 2, 0.7), ("d", 3, 0.99)], "d string, at int, q double")
    assert C.escalated(passes, "d", "at", "q").first()["at"] == 2


def test_engines(spark):
    work = spark.createDataFrame([("x",), ("y",)], "text string").coalesce(1)
    out = E.translated(work, [("none", E.absent("none")), ("echo", E.echo)], "en", "de").collect()
    assert [(r["tgt"], r["engine"]) for r in out] == [("[de] x", "echo"), ("[de] y", "echo")]
    assert E.translated(work, [("none", E.absent("none"))], "en", "de").where("tgt is null").count() == 2
    assert value(spark, E.reply_by_id(a, F.array(F.lit("1"), F.lit("0"))), a='{"0":"x","1":"y"}') == ["y", "x"]
    assert value(spark, E.reply_by_id(a, F.array(F.lit("7"))), a='{"0":"x"}') is None
    assert value(spark, E.reply_list(a), a='Sure: ["b","a","b"] done') == ["b", "a"]


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
XLSX = {"xl/sharedStrings.xml": '<sst xmlns="urn:s"><si><t>Hello</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="urn:s"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3</v></c><c r="C1" t="str"><f>1</f><v>x</v></c></row></sheetData></worksheet>'}
PPTX = {"ppt/slides/slide1.xml": '<sld xmlns:a="urn:a"><a:p><a:r><a:t>One</a:t></a:r><a:r><a:t> two</a:t></a:r></a:p></sld>', "ppt/notesSlides/notesSlide1.xml": '<n xmlns:a="urn:a"><a:p><a:t>Note</a:t></a:p></n>'}


def test_containers(spark):
    docx = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', "word/header1.xml": f"<w:hdr {W}><w:p><w:t>Top</w:t></w:p></w:hdr>"})
    odt = archive({"content.xml": '<o xmlns:t="urn:t"><t:h>H</t:h><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list><t:p>p</t:p></o>'})
    epub = archive({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="x" href="x.html"/><itemref idref="x"/></p>', "o/x.html": "<html><head><title>t</title></head><body><p>Hi</p></body></html>"})
    html = b"<html><head><title>T</title></head><body><h1>A</h1><p>b<p>c<table><tr><th>x</th><td>y</td></tr></table><script>no</script></body></html>"
    files = [("a.docx", docx, "docx"), ("b.odt", odt, "odt"), ("c.epub", epub, "epub"), ("d.html", html, "html"), ("e.xlsx", archive(XLSX), "xlsx"), ("f.pptx", archive(PPTX), "pptx"), ("g.docx", b"broken", "docx"), ("h.x", b"", "x"), ("i.odt", archive({"content.xml": "<!DOCTYPE x><x/>"}), "odt")]
    rows = K.blocks(spark.createDataFrame(files, "path string, content binary, kind string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["ord"])):
        got.setdefault(r["path"], []).append((r["type"], r["text"]) if r["error"] is None else r["error"])
    assert got["a.docx"] == [("heading", "Head"), ("table", "a\tb"), ("header", "Top")]
    assert got["b.odt"] == [("heading", "H"), ("list_item", "i"), ("paragraph", "p")]
    assert got["c.epub"] == [("paragraph", "Hi")] and got["e.xlsx"] == [("cell", "Hello")]
    assert got["d.html"][0] == ("title", "A") and ("table", "x\ty") in got["d.html"]
    assert got["f.pptx"] == [("paragraph", "One two"), ("note", "Note")]
    assert "BadZipFile" in got["g.docx"][0] and "no reader" in got["h.x"][0] and "Refused" in got["i.odt"][0]


def test_write_back(spark):
    files = spark.createDataFrame([("x", archive(PPTX))], "path string, content binary")
    new = spark.createDataFrame([("x", "slide1#0", "=Eins")], "path string, id string, text string")
    out = archives.written_back(files, new, "pptx").first()["content"]
    assert K.pptx_blocks(bytes(out))[0][2] == "=Eins" and K.pptx_blocks(bytes(out))[1][2] == "Note"
    assert K.xlsx_blocks(archives.xlsx(archive(XLSX), {"sheet1!A1": "=1"})) == [] and b"inlineStr" in zipfile.ZipFile(io.BytesIO(archives.xlsx(archive(XLSX), {"sheet1!A1": "=1"}))).read("xl/worksheets/sheet1.xml")


def test_kinds(spark):
    rows = [("a/x.pdf", b"%PDF-1.7"), ("y.docx", b"PK\x03\x04"), ("z.bin", b"PK\x03\x04"), ("s.srt", b"1\n"), ("p.dat", b"<!DOCTYPE html>"), ("t.unk", b"plain"), ("o.unk", b"\xff\xfe\x00\x81\x82")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert {r["path"]: r["k"] for r in df.select("path", K.kind(F.col("path"), F.col("content")).alias("k")).collect()} == {"a/x.pdf": "pdf", "y.docx": "docx", "z.bin": "zip", "s.srt": "subtitle", "p.dat": "html", "t.unk": "text", "o.unk": "unknown"}
    assert value(spark, K.sidecar(a), a="x/y.ref.de.txt") and not value(spark, K.sidecar(a), a="x/y.txt")


def test_subtitles_and_markdown(spark):
    text = "WEBVTT\n\n1\n00:01 --> 00:02\nHi\nyou\n\n\n2\n00:03 --> 00:04\n\n"
    cues = B.cues(spark.createDataFrame([("f", text)], "path string, text string"))
    assert [(r["id"], r["body"]) for r in cues.orderBy("n").collect()] == [("cue0", ""), ("cue1", "Hi\nyou"), ("cue2", "")]
    assert B.composed(cues).first()["text"] == "WEBVTT\n\n1\n00:01 --> 00:02\nHi\nyou\n\n2\n00:03 --> 00:04\n"
    assert value(spark, render.table_markdown(F.array(F.array(F.lit("h"), a), F.array(F.lit("1"), F.lit("a|b")))), a="k") == "| h | k |\n| --- | --- |\n| 1 | a\\|b |"


def test_tmx_and_glossary_files(spark, tmp_path):
    markup = spark.createDataFrame([("a < b", "x & y")], "s string, t string").select(B.unit_markup(F.col("s"), F.col("t"), "en", "de").alias("u")).first()["u"]
    (tmp_path / "m.tmx").write_text(f"<tmx><body>{markup}</body></tmx>")
    (tmp_path / "g.csv").write_text("﻿source,target,src_lang,tgt_lang,domain\nCat,Katze,,de,\nx,,,,\n")
    assert B.translation_units(spark, str(tmp_path / "m.tmx")).first()[:] == ("en", "a < b", "de", "x & y")
    assert [r[:] for r in B.glossary_csv(spark, str(tmp_path / "g.csv"), "en", "fr").collect()] == [("Cat", "Katze", "en", "de", "")]


def test_bleu():
    assert X.bleu_from_counts([4, 3, 2, 1], [4, 3, 2, 1], 4, 4) == pytest.approx(100)
    assert X.bleu_from_counts([2, 1], [2, 1], 4, 2) == pytest.approx(100 * math.exp(-1))
    assert X.bleu_from_counts([0, 0], [2, 1], 4, 2) == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("e", i, f, float(i)) for i, f in enumerate([True, True, False])], "engine string, seq long, failed boolean, at double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stores.breaker(stream).writeStream.format("memory").queryName("open_breakers").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["open"] for r in spark.table("open_breakers").orderBy("seq").collect()] == [False, True, False]
    stores.appended(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_edit_distance_of_words_against_the_table():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 14)) for _ in range(2))
        assert X.edit_distance(a, b) == table(a, b)
    long = [f"w{i}" for i in range(60_000)]  # more words than characters that a code could tell apart
    assert X.edit_distance(long, ["new", *long[:50_000]]) == 10_001


def test_entities_cost_in_proportion(spark):
    import time

    took = []
    for n in (4_000, 4_000, 16_000):
        row = spark.createDataFrame([(" ".join(str(i * 7) for i in range(n)), " ".join(str(i * 7) for i in range(1, n)))], "a string, b string")
        began = time.time()
        assert row.select(T.missing_entities(F.col("a"), F.col("b")).alias("m")).first()["m"] == ["0"]
        took.append(time.time() - began)
    assert took[2] < 5 * took[1] + 1, took


def brute_spans(text, terms):
    found = sorted({m.span() for p in (P.TAG, *P.PATTERNS) for m in re.finditer(p, text)} | {s for t in (*P.BRANDS, *terms) for s in P.occurrences(text, t)}, key=lambda s: (s[0], s[0] - s[1]))
    out = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def test_protected_spans_against_brute_force():
    rng = random.Random(2)
    parts = ["GitHub", "v2.4.6", "12:30", "see www.own.test now", "me@own.test", "[PH3]", "[ PH1 ]", "40 %", "7 km", "$x_1$", "\\alpha{b}", "a_1", "AB-1234", "#tag", "@who_1", "+49 (30) 1234 567", "plain", "Rev", "Revenue", "猫が", "3-9", "1e-5", "€ 5"]
    for _ in range(300):
        text = rng.choice([" ", "", ", "]).join(rng.choices(parts, k=rng.randint(0, 8)))
        assert P.spans(text, ["Rev", "猫", " "]) == brute_spans(text, ["Rev", "猫"])
        masked, meant = P.mask(text, ["Rev"], {"Rev": "Put"})
        assert P.unmask(masked, {k: "Rev" if v == "Put" else v for k, v in meant.items()}) == text
    assert P.unmask("a [PH0] b [ PH7]", {0: "x"}) == "a x b " and P.unmask("[PH0]", {}) == "[PH0]"
    assert list(P.occurrences("Rev Revenue xRev Rev_", "Rev")) == [(0, 3)] and list(P.occurrences("猫猫", "猫")) == [(0, 1), (1, 2)]


def test_adherence_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    letters = ["the", "old mill", "tion", "a", "b c", "x y z", "mill", "ill", "ÄB", "old mill house", "%", " the "]
    texts = [rng.choice([" ", "", ", "]).join(rng.choices([*letters, "word", "milling", "Q"], k=6)) for _ in range(60)]
    want = {(i, t, (t.upper() in x)) for i, x in enumerate(texts) for t in letters if t in x}
    blocks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = spark.createDataFrame([(t, t.upper()) for t in letters], "term string, rendering string")
    for small in (1000, 2):
        monkeypatch.setattr(S, "SMALL_GLOSSARY", small)
        assert {(r["id"], r["term"], r["applied"]) for r in S.adherence(blocks, terms).collect()} == want


def test_findings_of_a_glossary(spark):
    rows = spark.createDataFrame([(1, "the old mill stands", "die alte Muehle steht", "de"), (2, "the mill", "die Mühle", "de"), (3, "", "x", "de"), (4, "a mill", "", "de")], "id long, src string, tgt string, lang string")
    glossary = spark.createDataFrame([("mill", "Mühle"), ("old", "alte")], "term string, rendering string")
    got = {r["id"]: [(f["check"], f["detail"]) for f in r["findings"]] for r in S.findings(rows, glossary=glossary).collect()}
    assert got == {1: [("glossary", "mill -> Mühle")], 2: [], 3: [], 4: [("empty", "nothing was translated")]}
    assert "_lost_terms" not in S.findings(rows).columns


def test_fuzzy_search_against_brute_force(spark):
    import difflib

    rng = random.Random(4)
    words = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(80)]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:15])], "q_id long, norm string")
    tm = spark.createDataFrame([(i, t, t.upper()) for i, t in enumerate(texts)], "c_id long, norm string, tgt_text string")
    want = set()
    for q, a in enumerate(texts[:15]):
        scored = [(difflib.SequenceMatcher(None, a, b).ratio(), c) for c, b in enumerate(texts) if a != b and set(a.split()) & set(b.split())]
        best = sorted(((-s, c) for s, c in scored if s >= 0.5))[:5]
        want |= {(q, c, k + 1, round(-s, 9)) for k, (s, c) in enumerate(best)}
    assert {(r["q_id"], r["c_id"], r["rank"], round(r["score"], 9)) for r in M.fuzzy(queries, tm).collect()} == want
    assert M.fuzzy(queries, tm, cap=1).groupBy("q_id").count().where("count > 1").isEmpty()


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "QUERY_BLOCK", 3)
    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    vectors = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in vectors]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(99, None)], "id long, vector array<float>").repartition(3)
    got = {(r["q_id"], r["rank"]): r["c_id"] for r in M.nearest(rows.where("id % 4 = 0"), rows, 3).collect()}
    f = [list(map(float, v)) for v in (r["vector"] for r in rows.where("vector is not null").orderBy("id").collect())]
    for q in range(0, 40, 4):
        order = sorted((c for c in range(40) if c != q), key=lambda c: (-round(max(0.0, min(1.0, sum(x * y for x, y in zip(f[q], f[c], strict=True)))), 6), c))
        assert [got[q, k + 1] for k in range(3)] == order[:3]


def test_kendall_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(g, rng.randint(0, 8), rng.randint(0, 8)) for g in range(6) for _ in range(rng.randint(1, 25))]
    want = {}
    for g in range(6):
        own = [(a, b) for h, a, b in rows if h == g]
        pairs = [(x, y) for x in own for y in own if x[0] < y[0]]
        if pairs:
            want[g] = (pytest.approx(sum((y[1] > x[1]) - (y[1] < x[1]) for x, y in pairs) / len(pairs)), len(pairs))
    got = {r["g"]: (r["tau"], r["n_pairs"]) for r in L.kendall(spark.createDataFrame(rows, "g long, a long, b long"), "g", "a", "b").collect()}
    assert got == want


def test_large_files_and_hidden_document_types(spark, tmp_path, monkeypatch):
    (tmp_path / "big.html").write_text("<p>" + "x" * 3_000_000)
    (tmp_path / "small.html").write_text("<p>kept</p>")
    monkeypatch.setattr(containers, "MAX_FILE_MB", 1)
    rows = containers.files(spark, str(tmp_path)).withColumn("kind", F.lit("html"))
    got = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in containers.blocks(rows).collect()}
    assert got["small.html"] == ("kept", None) and got["big.html"][0] is None and "larger" in got["big.html"][1]
    for bad in (b"<!--" + b"x" * 10_000 + b"--><!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>", b" " * 9 + b"<!DOCTYPE a><a/>"):
        with pytest.raises((containers.Refused, ElementTree.ParseError)):
            containers.xml(bad)
    assert containers.xml(b"<a>&lt;!DOCTYPE</a>").text == "<!DOCTYPE"


DOCX = '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>'
NOTES = '<w:footnotes xmlns:w="urn:w"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnotes>'
ODT = '<o xmlns:t="urn:t" xmlns:b="urn:b"><t:h>H <t:span>x</t:span></t:h><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list><b:table><b:table-row><b:table-cell><t:p>c</t:p></b:table-cell><b:table-cell><t:p>d</t:p></b:table-cell></b:table-row></b:table><t:p/><t:p>p</t:p></o>'
PAGE_XHTML = '<?xml version="1.0"?><!DOCTYPE html><html dir="ltr"><head><title>T &amp; t</title><style>p{a:"&"}</style></head><body><!-- c --><p class="x">Hi &lt;you&gt;<br/> and <b>us</b></p></body></html>'


def test_write_back_of_every_kind(spark):
    docx = archive({"word/document.xml": DOCX, "word/footnotes.xml": NOTES, "other.bin": "kept"})
    odt, book = archive({"content.xml": ODT}), archive({"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="x" href="x.html"/><itemref idref="x"/></p>', "o/x.html": PAGE_XHTML})
    cases = [("docx", docx, {"p0": "Eins <zwei>", "t1": "A\tB", "p2": "Ende", "footnotes.xml#0": "Anm."}), ("odt", odt, {"o0": "Kopf", "o1": "I & J", "o2": "C\tD", "o3": "P"}), ("epub", book, {"x#0": "Hallo <du>", "x#1": "und", "x#2": "wir"})]
    for kind, content, texts in cases:
        before = K.READERS[kind](content)
        assert {b[0] for b in before} == set(texts)
        files = spark.createDataFrame([(kind, content)], "path string, content binary")
        new = spark.createDataFrame([(kind, k, v) for k, v in texts.items()], "path string, id string, text string")
        out = bytes(archives.written_back(files, new, kind).first()["content"])
        assert [(b[0], b[1]) for b in K.READERS[kind](out)] == [(b[0], b[1]) for b in before]
        assert {b[0]: b[2] for b in K.READERS[kind](out)} == texts
        assert {b[0]: b[2] for b in K.READERS[kind](archives.WRITERS[kind](content, {}))} == {b[0]: b[2] for b in before}
        assert [i.filename for i in zipfile.ZipFile(io.BytesIO(out)).infolist()] == [i.filename for i in zipfile.ZipFile(io.BytesIO(content)).infolist()]
    assert zipfile.ZipFile(io.BytesIO(archives.docx(docx, {}))).read("other.bin") == b"kept" and b"<w:b" in zipfile.ZipFile(io.BytesIO(archives.docx(docx, {"p0": "x"}))).read("word/document.xml")
    page = zipfile.ZipFile(io.BytesIO(archives.epub(book, {}, "rtl"))).read("o/x.html").decode()
    assert '<html dir="rtl">' in page and page.replace('dir="rtl"', 'dir="ltr"') == PAGE_XHTML
    with pytest.raises(K.Refused):
        archives.docx(docx, {"t1": "A"})


def test_a_document_is_built_and_read_again():
    blocks = [{"type": "title", "text": "T <1>"}, {"type": "heading", "text": "H", "level": 2}, {"type": "list_item", "text": "i", "level": 5}, {"type": "paragraph", "runs": [("a ", {}), ("b", {"bold": True, "sup": True})], "rtl": True, "align": "right"}, {"type": "table", "rows": [[("x", 1, 2), ("y", 2, 1)], ["z", "w"]]}]
    out = archives.docx_built(blocks)
    assert [(b[1], b[2]) for b in K.docx_blocks(out)] == [("title", "T <1>"), ("heading", "H"), ("list_item", "i"), ("paragraph", "a b"), ("table", "x\ty\n\tz\tw")]
    body = zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml").decode()
    assert body.count("<w:vMerge") == 2 and 'w:val="ListBullet3"' in body and "<w:bidi/>" in body


def test_interchange(spark, tmp_path):
    rows = spark.createDataFrame([("en", "de", "", "=term", "Wort", "user", True), ("en", "fr", "law", "mill", "moulin", "import", False)], "src_lang string, tgt_lang string, domain string, term string, rendering string, origin string, locked boolean")
    for kind in ("tsv", "json"):
        B.write_glossary(rows, str(tmp_path / kind), kind)
        got = sorted(tuple(r) for r in B.glossary_entries(spark, str(tmp_path / kind), kind).collect())
        assert got == sorted((*r[:3], ("'" if kind == "tsv" and r[3] == "=term" else "") + r[3], *r[4:]) for r in map(tuple, rows.collect()))
    (tmp_path / "list.json").write_text('[{"term": "a", "rendering": "b", "src_lang": "en", "tgt_lang": "de", "locked": 1}, {"term": "", "rendering": "x", "src_lang": "en", "tgt_lang": "de"}]')
    assert [tuple(r) for r in B.glossary_entries(spark, str(tmp_path / "list.json"), "json").collect()] == [("en", "de", "", "a", "b", "user", True)]
    B.write_glossary(rows, str(tmp_path / "csv"), "csv")
    assert {(r["term"], r["rendering"]) for r in B.glossary_csv(spark, str(tmp_path / "csv")).collect()} == {("'=term", "Wort"), ("mill", "moulin")}
    B.write_review(spark.createDataFrame([("b1", "one", "eins")], "block_id string, source string, translation string"), str(tmp_path / "review"))
    assert [tuple(r) for r in B.review_tsv(spark, str(tmp_path / "review")).collect()] == [("b1", "one", "eins", None)]
    record = spark.createDataFrame([("2024-02-01", 0.5)], "date string, overall double")
    for _ in range(2):
        B.append_history(record, str(tmp_path / "history"))
    assert B.history(spark, str(tmp_path / "history"), "date string, overall double").count() == 2


def test_types_of_matched_blocks(spark):
    rng = random.Random(6)
    schema = "doc long, page int, ord long, type string, x0 double, y0 double, x1 double, y1 double"
    rows = lambda n: [(1, rng.randrange(2), k, rng.choice(["text", "table", None]), float(x := rng.randrange(30)), float(y := rng.randrange(30)), x + 12.0, y + 12.0) for k in range(n)]
    reference, found = rows(200), rows(150)
    # one place twice: the box that matches has its own type, not the other's
    reference += [(2, 0, 7, "code", 0.0, 0.0, 10.0, 10.0), (2, 0, 7, "figure", 50.0, 50.0, 60.0, 60.0)]
    found += [(2, 0, 0, "formula", 0.0, 0.0, 10.0, 9.0)]
    want = {}
    for page in {r[:2] for r in reference}:
        a_s, b_s = ([r for r in side if r[:2] == page] for side in (reference, found))
        iou = lambda a, b: (s := max(0.0, min(a[6], b[6]) - max(a[4], b[4])) * max(0.0, min(a[7], b[7]) - max(a[5], b[5]))) / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - s)
        for x, y, _ in L.greedy([(i, j, iou(a, b)) for i, a in enumerate(a_s) for j, b in enumerate(b_s) if iou(a, b) >= 0.5]):
            want[a_s[x][3], b_s[y][3]] = want.get((a_s[x][3], b_s[y][3]), 0) + 1
    out = pages.typing_match(spark.createDataFrame(reference, schema), spark.createDataFrame(found, schema))
    assert {(r["reference"], r["found"]): r["n"] for r in out.collect()} == want and want["code", "formula"] == 1
    assert "Join" not in out._jdf.queryExecution().toString()  # a page's pairs are never rows


def test_matching_blocks_are_difflibs():
    rng = random.Random(3)
    for k in range(400):
        letters = ("ab", "abcde ", "thinoaesrdlwuy ,.bg", "abcdefghijklmnopqrstuvwxyz")[k % 4]
        weights = [rng.random() ** 3 + 0.01 for _ in letters]
        text, candidate = ("".join(rng.choices(letters, weights, k=rng.choice(n))) for n in ([0, 1, 5, 80, 230], [1, 7, 8, 60, 199, 200, 210, 500]))
        candidate = candidate[: k % 99] + text[: k % 50] + candidate[k % 99 :]
        want = sum(b.size for b in difflib.SequenceMatcher(None, text, candidate).get_matching_blocks())
        own = X.Blocks(candidate)
        assert own.matched(text) == own.matched(text, want) == want and own.matched(text, want + 1) in (None, want)


def test_fuzzy_of_a_stated_set_scores_no_joined_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = ["tion", "the", "and", "of", "rest", "bly", "qua", "vex", "jo"]
    text = lambda n: " ".join(rng.choices(words, range(len(words), 0, -1), k=n))
    queries = [(k, text(rng.choice([3, 20, 45]))) for k in range(25)] + [(99, ""), (98, None), (97, "alone")]
    # copies of a query, of each other (ties go to the smaller id), near copies, long texts whose common characters are popular
    rows = [(k, text(rng.choice([2, 15, 40, 70]))) for k in range(120)]
    rows += [(200 + k, q) for k, (_, q) in enumerate(queries[:5])] + [(300 - k, rows[3][1]) for k in range(8)] + [(400 + k, q + " vex jo") for k, (_, q) in enumerate(queries[5:12])] + [(500, None), (501, "  ")]
    parts = lambda x: {t for t in re.split(r"[^\w]+", x) if t}
    want = set()
    for q_id, q in queries:
        scores = [(-difflib.SequenceMatcher(None, q, c).ratio(), c_id, c) for c_id, c in rows if q and c and q != c and parts(q) & parts(c)]
        want |= {(q_id, c_id, rank, -score, c) for rank, (score, c_id, c) in enumerate(sorted(x for x in scores if x[0] <= -0.3)[:5], 1)}
    q, c = spark.createDataFrame(queries, "q_id long, norm string"), spark.createDataFrame([(i, t, t) for i, t in rows], "c_id long, norm string, tgt_text string")
    for block in (M.QUERY_BLOCK, 10):
        monkeypatch.setattr(M, "QUERY_BLOCK", block)
        out = M.fuzzy(q, c, least=0.3, stated=True)
        assert {tuple(r) for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().toString()


def test_mined_terms_end_at_letters_beyond_ascii_as_their_sql_does(spark, tmp_path):
    docs = [(1, "Foo éBar Bar\u00e9 ñNASA NASAé. Qua\u0301 Qua Xerx ïxerx", "en"), (2, "Lob\x0bDon Lob Don Vip\u2003Wag Vip Wag Éric éric Foo Ab_ Abc_ Abc Abc", "en"), (3, "Foo Foo", "de"), (4, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(db.execute(Q.ORACLES["auto_glossary"]).fetchall())
    assert {tuple(r) for r in Q.QUERIES["auto_glossary"](spark, str(tmp_path)).collect()} == want and ("NASA", "acronym", 2) in want


def test_spans_at_the_bound_are_those_of_the_sql(spark, tmp_path):
    # a span and an image that covers just 0.35 of it, of sf0.1; of the last pair it covers less
    pairs = [(2, (283, 3713, 36), (286, 224, 8)), (4, (588, 14956, 25), (583, 8918, 45)), (2, (377, 8217, 26), (380, 11711, 9)), (2, (283, 3713, 36), (286, 224, 7))]
    rows = [(o, p, k, page, float(wide), "A", "O") for k, (page, *both) in enumerate(pairs) for o, p, wide in both]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(db.execute(LQ.ORACLES["span_over_image"]).fetchall())
    assert sorted(map(tuple, LQ.QUERIES["span_over_image"](spark, str(tmp_path)).collect())) == want == [(0, 2, 283), (1, 4, 588), (2, 2, 377)]
