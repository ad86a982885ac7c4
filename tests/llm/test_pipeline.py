"""The pipeline against brute force, stage by stage on each stage's own input."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_dedup import WORDS, brute_components, brute_lines, edited

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain_verdict(text):
    """The quality stage's verdict, counted character by character."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = len(words)
    if n < 50 or 100 * len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}) > 50 * n:
        return False
    repeated = len(lines) - len(set(lines))
    return not (
        10 * sum(c in "#*$%&|<>" for c in text) > n
        or not 2 * n <= sum(map(len, words)) <= 15 * n
        or repeated >= 3 and 10 * repeated > 3 * len(lines)
        or 10 * text.count("!!") > n
        or 2 * sum(c.isupper() for c in text) > sum(c.isalpha() for c in text)
        or 2 * sum(not any(c.isalnum() for c in w) for w in words) > n
        or 10 * max(map(words.count, words)) > 3 * n
    )


def fixture():
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices(WORDS, k=n)) + "."
    items = [(k, text(25)) for k in range(3)]
    shared, base = text(70), [text(120) for _ in range(6)]
    rows = []
    for d in range(60):
        body = edited(rng, rng.choice(base), rng.choice([0, 0.004, 0.5]))
        if d % 5 == 0:
            body += "\n" + shared
        if d % 7 == 0:
            body += " " + items[d % 3][1]
        rows.append((d, body.upper() + "!!" if d % 11 == 10 else body, "en", "s", len(body)))
    return [*rows, (60, None, None, None, None), (61, "", "en", "s", 0), (62, "short text", "en", "s", 10), (None, base[0] + " own", "en", "s", 5)], items


def test_stages(spark, tmp_path):
    rows, items = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, kept = {d: t for d, t, *_ in rows}, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            want = {d: t for d, t in want.items() if plain_verdict(t)}
        elif name == "line_dedup":
            gone = brute_lines([(d, t) for d, t in want.items()], 1)
            assert gone
            want = {d: t if d is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in want.items()}
        elif name == "near_dup":
            roots = brute_components([(d, t) for d, t in want.items()], 5, 80)
            want = {d: t for d, t in want.items() if d is None or roots[d][1] == d}
        elif name == "decontamination":
            low = lambda t: " ".join(t.lower().split())
            hit = {d for d, t in want.items() if d is not None and any(low(i)[6:-6] in low(t) for _, i in items)}
            assert hit
            want = {d: t for d, t in want.items() if d not in hit}
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
            assert docs.count() == len(want)
            kept.append(len(want))
    assert kept == sorted(kept, reverse=True) and kept[-1] > 5
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(x): int(y) for x, y in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    for r in docs.collect():
        ids = codec.encode_ordinary(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows, a very long text and columns beside those of documents."""
    spark.createDataFrame([(1, "an item of the benchmark that no text holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, rep string"
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long, "en", "s", 1, 1, "x"), (1, long, "en", "s", 1, 1, "x"), (None, long, None, None, None, None, None), (2, None, None, None, None, None, None), (3, "", "", "", 0, 0, "")]
    for k, given in enumerate(([], rows)):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert name == "byte_bpe" or docs.columns == list(corpus_pipeline.COLUMNS)
        assert docs.count() == 3 * k


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_the_bench_times_every_training_data_query():
    import __spark_entry__
    import bench

    assert {n for n in __spark_entry__.queries() if n[:2] == "op" and n[2].isdigit() or n == "pipeline"} <= set(bench.HEADLINE)
