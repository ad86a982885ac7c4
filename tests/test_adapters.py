"""Adapters against made-up services and models."""

from __future__ import annotations

import json

import pytest

from papyrion.operators import adapters as A
from papyrion.operators import documents as D
from papyrion.operators import engines as E

WAIT = {"sleep": lambda s: None}


def test_web_endpoint_pieces_and_retries():
    asked = []

    def transport(url, payload):
        q = payload["query"]
        asked.append((q["sl"], q["tl"], len(q["q"])))
        if len(asked) % 3 == 1:
            raise OSError("busy")
        return [[["<" + q["q"] + ">"]]]

    out = A.google(transport, **WAIT)(["one", " ", "a sentence. " * 500], "", "zh")
    assert out[:2] == ["<one>", " "] and out[2].replace("<", "").replace(">", "") == "a sentence. " * 500
    assert {a[:2] for a in asked} == {("auto", "zh-CN")} and max(a[2] for a in asked) <= A.WEB_CHARS
    with pytest.raises(E.NotAvailable):
        A.google(lambda u, p: [[["  "]]], **WAIT)(["x"], "en", "de")


def test_waits_grow():
    waits = []
    with pytest.raises(E.NotAvailable):
        A.patient(lambda: 1 / 0, sleep=waits.append)
    assert len(waits) == 4 and all(A.FIRST_WAIT * 2**k <= w <= A.FIRST_WAIT * 2**k * 1.5 for k, w in enumerate(waits))


def test_other_services():
    good = A.mymemory(lambda u, p: {"responseStatus": 200, "responseData": {"translatedText": p["query"]["langpair"]}}, **WAIT)
    assert good(["x"], "", "de") == ["en|de"]
    with pytest.raises(E.NotAvailable):
        A.mymemory(lambda u, p: {"responseStatus": "403", "responseDetails": "limit"}, **WAIT)(["x"], "en", "de")
    libre = A.factory("libretranslate", lambda u, p: {"translatedText": f"{u} {p['json']['source']}"}, base="http://own.test/", **WAIT)
    assert libre(["x"], "", "de") == ["http://own.test/translate auto"]
    with pytest.raises(E.NotAvailable):
        A.factory("unknown")


def test_models_in_chunks_and_by_pivot():
    sizes = []

    def load():
        return lambda texts, s, t: sizes.append(len(texts)) or [f"{s}>{t}:{x}" for x in texts]

    engine = A.model("m", load, {"en": "E", "de": "D"}, chunk=2)
    assert engine(["a", " ", "b", "c"], "en-GB", "de") == ["E>D:a", " ", "E>D:b", "E>D:c"] and sizes == [2, 1]
    with pytest.raises(E.NotAvailable):
        engine(["a"], "en", "xx")
    with pytest.raises(E.NotAvailable):
        A.model("m", lambda: __import__("no_such_library"))(["a"], "en", "de")
    pairs = {("fr", "en"), ("en", "de")}
    direct = lambda s, t: (lambda texts, a, b: [f"{x}+{b}" for x in texts]) if (s, t) in pairs else None
    assert A.pivoted(direct)(["x"], "fr", "de") == ["x+en+de"] and A.pivoted(direct)(["x"], "de", "de") == ["x"] and A.pivoted(direct)(["x"], "en", "de") == ["x+de"]
    with pytest.raises(E.NotAvailable):
        A.pivoted(direct)(["x"], "de", "fr")


def test_lists_of_a_language_model():
    replies = lambda system, content: "Sure: " + json.dumps([x.upper() for x in json.loads(content) if x != "drop"])
    assert A.by_list(replies, 2)(["a", "b", "drop", "c"], "en", "de") == ["A", "B", "drop", "c"]
    with pytest.raises(E.NotAvailable):
        A.by_list(replies, 2, keep_source=False)(["a", "drop"], "en", "de")
    assert A.found_list("no list") is None and A.found_list("[1, ") is None


def test_chunks_are_halved_until_they_align():
    asked = []

    def ask(system, content):
        texts = json.loads(content)["texts"]
        asked.append(len(texts))
        return json.dumps({i: t.upper() for i, t in texts.items()}) if len(texts) <= 2 else json.dumps({})

    assert A.by_id(ask, 5)(["a", "b", "c", "d", "e"], "en", "de") == ["A", "B", "C", "D", "E"] and asked == [5, 2, 3, 1, 2]
    with pytest.raises(E.NotAvailable):
        A.by_id(lambda s, c: "{}")(["a"], "en", "de")
    sent = []
    reply = A.chat("http://own.test", "m", lambda u, p: sent.append(p) or {"choices": [{"message": {"content": "ok"}}]}, "k", **WAIT)
    assert reply("s", "c") == "ok" and sent[0]["headers"] == {"Authorization": "Bearer k"} and sent[0]["json"]["messages"][1]["content"] == "c"


def test_suggestions():
    ask = lambda system, content: '["Eins", "zwei", "eins ", "zwei", "drei", "vier"]'
    assert A.alternatives(ask, "one", "de", translation="EINS") == ["zwei", "drei", "vier"] and A.synonyms(ask, "drei", "x", 2) == ["Eins", "zwei"]
    assert A.mended(lambda s, c: " fixed ", "fixd") == "fixed" and A.mended(lambda s, c: "x" * 99, "fixd") == "fixd" and A.mended(lambda s, c: " ", "fixd") == "fixd"


def test_recognisers_in_a_chain(spark):
    def absent(content):
        raise E.NotAvailable("not here")

    box = [(0, 0), (4, 2)]
    weak = lambda content: [("we", 0.3, box), ("ak", 0.9, box)] if content else []
    strong = lambda content: [("Strong", 0.9, box)] if content != b"none" else []
    images = spark.createDataFrame([(1, 0, b"x"), (2, 0, b""), (3, 0, b"none")], "doc long, page int, content binary")
    out = A.recognised_words(images, [("absent", absent), ("weak", weak), ("strong", strong)])
    assert {(r["doc"], r["text"], r["engine"]) for r in out.collect()} == {(1, "Strong", "strong"), (2, "Strong", "strong"), (3, "we", "weak"), (3, "ak", "weak")}
    assert {(r["text"], r["box"]["x1"], len(r["flags"])) for r in D.recognised(out).collect()} == {("Strong", 4.0, 0), ("we", 4.0, 1), ("ak", 4.0, 0)}
    assert A.selected("auto", {"b": 2}, ("a", "b")) == 2
    with pytest.raises(E.NotAvailable):
        A.selected("a", {"b": 2})
