"""Document rules, styles along alignments, and whole documents translated, on small fixtures."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrion.operators import alignment as A
from papyrion.operators import documents as D
from papyrion.operators import engines as E
from papyrion.operators import layout as L
from papyrion.operators import memory as M
from papyrion.operators import translate as X


def restyled(spark, runs, translated, links):
    rows = spark.createDataFrame([(1, k, t, s) for k, (t, s) in enumerate(runs)], "id long, run long, text string, style string")
    target = spark.createDataFrame([(1, translated)], "id long, translated string")
    pairs = spark.createDataFrame([(1, s, t) for s, t in links], "id long, s int, t int")
    return [(r["text"], r["style"]) for r in A.restyled(rows, target, pairs).orderBy("run").collect()]


def test_styles_follow_words(spark):
    assert restyled(spark, [("one ", "plain"), ("deep", "bold"), (" lake", "plain")], " lac profond un", [(0, 2), (1, 1), (2, 0)]) == [(" lac ", "plain"), ("profond ", "bold"), ("un", "plain")]
    # neighbours of one style are one run; a word without a link goes with the one before it
    assert restyled(spark, [("a b ", "plain"), ("c", "bold")], "x  y z", [(0, 0), (1, 1)]) == [("x  y z", "plain")]
    # a majority decides, of equals the first word's style
    assert restyled(spark, [("a", "p"), (" b c", "q")], "x y", [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1)]) == [("x ", "q"), ("y", "p")]
    assert restyled(spark, [("a ", "p"), ("b", "q")], "w x y z", [(0, 0)]) == []  # a quarter of the words
    assert restyled(spark, [("a ", "p"), ("b", None)], "w x", [(0, 1), (1, 0)]) == [("w ", None), ("x", "p")]
    assert restyled(spark, [("a", "p")], " ", [(0, 0)]) == []


def test_word_links_of_vectors(spark):
    near = np.eye(3) * 12
    assert A.linked(near, near[[2, 0, 1]]) == [(0, 1), (1, 2), (2, 0)]
    assert A.linked(near, np.zeros((0, 3))) == []
    rows = spark.createDataFrame([(1, near.tolist(), near.tolist()), (2, None, near.tolist())], "id long, source array<array<double>>, target array<array<double>>")
    assert sorted(tuple(r) for r in A.links(rows).collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2)]


def test_merged_cells_take_the_next_free_slots(spark):
    cells = [("t", 0, 0, 2, 1, "a"), ("t", 0, 1, 1, 2, "b"), ("t", 1, 2, 1, 1, "c"), ("t", 1, 3, 1, 1, "d"), ("u", 0, 0, 1, 1, "e")]
    out = D.placed_cells(spark.createDataFrame(cells, "doc string, row int, ord int, rowspan int, colspan int, text string"), "doc").collect()
    assert {(r["doc"], r["row"], r["col"]): r["text"] for r in out} == {("t", 0, 0): "a", ("t", 1, 0): "", ("t", 0, 1): "b", ("t", 0, 2): "", ("t", 1, 1): "c", ("t", 1, 2): "d", ("u", 0, 0): "e"}


def test_box_fidelity(spark):
    schema = "doc long, page int, ord int, x0 double, y0 double, x1 double, y1 double, width double, height double"
    box = lambda doc, ord_, x, scale=1: (doc, 0, ord_, x * scale, 0.0, (x + 10) * scale, 10.0 * scale, 100.0 * scale, 100.0 * scale)
    source = spark.createDataFrame([box(1, 0, 0.0), box(1, 1, 50.0), box(2, 0, 0.0)], schema)
    output = spark.createDataFrame([box(1, 0, 0.0, 2), box(1, 1, 55.0, 2)], schema)
    got = {r["doc"]: (round(r["biou"], 4), r["coverage"], r["n"]) for r in D.box_fidelity(source, output).collect()}
    assert got == {1: (round(50 * (1 + 1 / 3), 4), 1.0, 2), 2: (0.0, 0.0, 1)}


def test_rules_of_blocks(spark):
    rows = spark.createDataFrame([(1, "שלום", None, ["x"]), (2, "plain", "left", []), (3, "  ", None, None)], "ord long, text string, align string, flags array<string>")
    got = {r["ord"]: (r["rtl"], r["align"]) for r in D.directed(rows, "text", F.lit("en")).collect()}
    assert got == {1: (True, "right"), 2: (False, "left"), 3: (False, None)}
    assert [r["ord"] for r in D.flagged(rows).collect()] == [1]
    runs = spark.range(1).select(D.cleaned_members(F.array(F.struct(F.lit("ﬁne").alias("text"), F.lit(1).alias("k"))))[0]["text"].alias("t"))
    assert runs.first()["t"] == "fine"
    e = spark.createDataFrame([("12 ducks", "12 Enten"), ("12 ducks", "Enten da"), ("", "x")], "a string, b string").select(D.estimated(F.col("a"), F.col("b")).alias("e"))
    assert [r["e"] for r in e.collect()] == [1.0, 0.5, None]
    assert D.output_text(F.lit(""), F.lit("x")) is not None
    old = spark.createDataFrame([("k", "t")], "norm string, tgt_text string")
    assert D.upgraded(old, "tm", 1).columns == ["norm", "tgt_text", "confirmed", "origin", "domain", "ctx"] and D.upgraded(old, "tm", 3).columns == ["norm", "tgt_text", "ctx"]
    stages = D.Stages()
    for _ in range(2):
        with stages.stage("read"):
            pass
    with pytest.raises(ZeroDivisionError), stages.stage("fail"):
        1 / 0
    assert set(stages.seconds) == {"read", "fail"}


def test_a_document_is_translated(spark):
    blocks = [(1, 0, "paragraph", "A known line"), (1, 1, "code", "A known line"), (1, 2, "paragraph", " See https://own.test at 12:30 "), (1, 3, "paragraph", " See https://own.test at 12:30 "), (1, 4, "paragraph", ""), (2, 0, "paragraph", "This rather long line is almost known to us"), (2, 1, "paragraph", "Price 7,305.25 for the mill"), (2, 2, "paragraph", "Weather was fair enough for the season today")]
    rows = spark.createDataFrame(blocks, "doc long, ord long, type string, text string")
    pairs = spark.createDataFrame([(1, "a KNOWN line", "Eine bekannte Zeile"), (2, "This rather long line is almost known to us!", "Fast bekannt"), (3, "Weather was fair enough for this reason today and", "Wetter")], "seq long, src string, tgt string")
    tm = M.memory(M.puts(pairs, "seq", "de"))
    seen: list = []

    def engine(texts, source, target):
        return ["<" + t.strip().replace("See", "Siehe") + ">" for t in texts]

    plan = X.Plan("en", "de", [("broken", E.absent("x")), ("own", engine)], glossary={"mill": "Mühle"})
    out = X.translate(rows, plan, tm)
    got = {(r["doc"], r["ord"]): (r["tgt"], r["origin"]) for r in out.blocks.collect()}
    assert len(got) == len(blocks) and not seen
    assert got[1, 0] == ("Eine bekannte Zeile", "memory") and got[1, 1] == (None, None) and got[1, 4] == (None, None)
    assert got[1, 2] == got[1, 3] == (" <Siehe https://own.test at 12:30> ", "own")
    assert got[2, 0] == ("Fast bekannt", "fuzzy")
    assert got[2, 1] == ("<Price 7.305,25 for the Mühle>", "own")
    assert [r["text"] for r in out.suggestions.collect()] == ["Weather was fair enough for the season today"]
    assert {r["norm"] for r in out.events.collect()} == {"see https://own.test at 12:30", "price 7,305.25 for the mill", "weather was fair enough for the season today"}
    found = {(r["doc"], r["ord"]): [f["check"] for f in r["findings"]] for r in out.blocks.collect()}
    assert found[1, 1] == [] and found[2, 0] == ["length"]
    assert X.translate(rows.limit(0), plan).blocks.count() == 0


def test_a_scorecard(spark):
    rows = spark.createDataFrame([(1, 0, "paragraph", "one two", 0), (1, 1, "heading", "three", 1)], "doc long, ord int, type string, text string, reading_order int").withColumn("cells", F.lit(0)).withColumn("flags", F.array().cast("array<string>"))
    card = X.scored(rows, spark.createDataFrame([(1, "one too three")], "doc long, reference string")).first()
    assert (card["blocks"], card["n_heading"], card["monotonic"], card["wer"]) == (2, 1, True, round(1 / 3, 4)) and 0 < card["cer"] < 0.3


def test_language_by_profile(spark):
    docs = spark.createDataFrame([(1, "the old mill and the river", "en"), (2, "der alte Fluss und die Mühle", "de"), (3, "the river", None), (4, "12 34", None), (5, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in D.language_of(docs, D.language_profiles(docs)).collect()}
    assert got == {1: "en", 2: "de", 3: "en", 4: None, 5: None}


def test_boxes_are_matched_as_greedily_without_joining_pairs(spark):
    rng = random.Random(5)
    schema = "doc long, page int, ord long, x0 double, y0 double, x1 double, y1 double, width double, height double"

    def rows(n: int) -> list[tuple]:
        at = lambda: float(rng.randrange(40))
        # few places and whole numbers, so that places repeat and scores tie; some rows lack a page or a side
        return [(rng.choice([1, 2, None]), rng.choice([0, 1, 2, None]), rng.randrange(n), x, y, rng.choice([x + 9, x + 4, None]), y + rng.randrange(12), 64.0, 64.0) for x, y in ((at(), at()) for _ in range(n))]

    source, output = rows(150), rows(120)
    want = {}
    for doc, page in {r[:2] for r in source}:
        own = [[r for r in side if r[:2] == (doc, page)] for side in (source, output)]
        pairs = []
        for a in own[0]:
            for b in own[1] if None not in (doc, page) else ():
                if None not in (*a, *b) and (w := min(a[5], b[5]) - max(a[3], b[3])) > 0 and (h := min(a[6], b[6]) - max(a[4], b[4])) > 0:
                    pairs.append((a[2], b[2], w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)))
        chosen = L.greedy(pairs)
        iou, matched, n = want.get(doc, (0.0, 0, 0))
        want[doc] = iou + sum(s for _, _, s in chosen), matched + len(chosen), n + len(own[0])
    out = D.box_fidelity(spark.createDataFrame(source, schema), spark.createDataFrame(output, schema))
    assert {r["doc"]: (round(r["biou"], 6), round(r["coverage"], 6), r["n"]) for r in out.collect()} == {d: (round(100 * i / n, 6), round(m / n, 6), n) for d, (i, m, n) in want.items()}
    assert "Join" not in out._jdf.queryExecution().toString()  # a page's pairs are never rows


def test_pages_larger_than_a_call_are_whole():
    rows = [(p, i) for p in range(5) for i in range(1 + 7 * p)]
    seen = []

    class Frame:
        repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = lambda self, f, _: list(f(iter(pa.RecordBatch.from_pydict({"doc": [p for p, _ in rows[k : k + 4]], "page": [0] * len(rows[k : k + 4])}) for k in range(0, len(rows), 4))))

    def run(table: pa.Table, page: np.ndarray) -> pa.Table:
        seen.extend(zip(table.column("doc").to_pylist(), page.tolist(), [len(seen)] * table.num_rows, strict=True))
        return table

    size, L.CALL_ROWS = L.CALL_ROWS, 6
    try:
        out = L.whole_pages(Frame(), run, "")
    finally:
        L.CALL_ROWS = size
    assert [d for b in out for d in b.column("doc").to_pylist()] == [p for p, _ in rows]
    assert len({(doc, page, call) for doc, page, call in seen}) == 5 and len({call for *_, call in seen}) > 1
