"""Engines that need a service or a model: what they are asked, how replies are read, when they are asked again.

A service is reached by a transport, a function of (url, payload) that gives the decoded reply and raises on failure, so each
adapter can be run against a made-up one. Nothing is sent unless an engine made here is put into a chain.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from papyrion.functions.protect import cut
from papyrion.operators.engines import Engine, NotAvailable, language_code

Transport = Callable[[str, dict], Any]

# Limits of the services: characters of a request, threads, attempts, seconds before the next, texts of a chunk.
WEB_CHARS, MEMORY_CHARS, THREADS, ATTEMPTS, FIRST_WAIT = 4500, 480, 8, 5, 0.6
MODEL_CHUNK, ROUTED_CHUNK, HOSTED_CHUNK, LOCAL_CHUNK = 16, 30, 40, 12


def http(url: str, payload: dict) -> Any:
    """The plain transport: a GET with a query string for payload key `query`, else a POST of JSON with `headers` apart."""
    if "query" in payload:
        request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(payload['query'])}")
    else:
        request = urllib.request.Request(url, json.dumps(payload.get("json", {})).encode(), {"Content-Type": "application/json", **payload.get("headers", {})})
    with urllib.request.urlopen(request, timeout=120) as reply:
        return json.loads(reply.read())


def patient(ask: Callable[[], str], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> str:
    """Ask until it gives text; each wait is twice the last, and up to half as long again, so that many askers don't meet. An empty reply is a failure too."""
    why: Exception | None = None
    for k in range(attempts):
        if k:
            sleep(wait * 2 ** (k - 1) * (1 + random.random() / 2))
        try:
            if (reply := ask()).strip():
                return reply
            why = ValueError("an empty reply")
        except Exception as e:  # noqa: BLE001, a service may fail in any way
            why = e
    raise NotAvailable(f"no reply after {attempts} attempts: {why}")


def one_by_one(ask: Callable[[str, str, str], str], limit: int, threads: int = 1, **patience) -> Engine:
    """An engine from a function of one text: long texts go in pieces, blank ones aren't sent."""

    def one(text: str, source: str, target: str) -> str:
        if not text.strip():
            return text
        return "".join(patient(lambda p=piece: ask(p, source, target), **patience) if piece.strip() else piece for piece in cut(text, limit))

    def run(texts: list[str], source: str, target: str) -> list[str]:
        if threads == 1:
            return [one(t, source, target) for t in texts]
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(lambda t: one(t, source, target), texts))

    return run


def google(transport: Transport = http, **patience) -> Engine:
    """The web endpoint; its codes differ for Hebrew and Chinese."""
    fixed = {"he": "iw", "zh": "zh-CN"}

    def ask(text: str, source: str, target: str) -> str:
        reply = transport("https://translate.googleapis.com/translate_a/single", {"query": {"client": "gtx", "sl": fixed.get(source, source or "auto"), "tl": fixed.get(target, target), "dt": "t", "q": text}})
        return "".join(part[0] for part in reply[0] if part and part[0])

    return one_by_one(ask, WEB_CHARS, THREADS, **patience)


def mymemory(transport: Transport = http, **patience) -> Engine:
    """A reply whose status isn't 200 is a failure."""

    def ask(text: str, source: str, target: str) -> str:
        reply = transport("https://api.mymemory.translated.net/get", {"query": {"q": text, "langpair": f"{source or 'en'}|{target}"}})
        if str(reply.get("responseStatus")) != "200":
            raise ValueError(str(reply.get("responseDetails")))
        return reply["responseData"]["translatedText"]

    return one_by_one(ask, MEMORY_CHARS, **patience)


def libretranslate(base: str, transport: Transport = http, key: str = "", **patience) -> Engine:
    """X7."""

    def ask(text: str, source: str, target: str) -> str:
        sent = {"q": text, "source": source or "auto", "target": target, "format": "text", **({"api_key": key} if key else {})}
        return transport(f"{base.rstrip('/')}/translate", {"json": sent})["translatedText"]

    return one_by_one(ask, WEB_CHARS, **patience)


def model(name: str, load: Callable[[], Callable[[list[str], str, str], list[str]]], codes: dict[str, str] | None = None, chunk: int = MODEL_CHUNK) -> Engine:
    """An engine from a model that is loaded when it's first used, in chunks; a language without a code is an error, not a guess."""
    held: list = []

    def run(texts: list[str], source: str, target: str) -> list[str]:
        if not held:
            try:
                held.append(load())
            except Exception as e:  # noqa: BLE001, a missing library or file
                raise NotAvailable(f"{name} can't be loaded: {e}") from e
        a, b = (language_code(x, codes, name) if codes else x for x in (source, target))
        wanted = [k for k, t in enumerate(texts) if t.strip()]
        out = list(texts)
        for low in range(0, len(wanted), chunk):
            part = wanted[low : low + chunk]
            replies = held[0]([texts[k] for k in part], a, b)
            if len(replies) != len(part):
                raise NotAvailable(f"{name} gave {len(replies)} texts for {len(part)}")
            for k, reply in zip(part, replies, strict=True):
                out[k] = reply
        return out

    return run


def pivoted(direct: Callable[[str, str], Engine | None], pivot: str = "en") -> Engine:
    """An engine of pairs: the same language is left as it is; a pair without a model goes by way of the pivot."""

    def run(texts: list[str], source: str, target: str) -> list[str]:
        if source == target:
            return list(texts)
        if engine := direct(source, target):
            return engine(texts, source, target)
        first, second = (direct(source, pivot), direct(pivot, target)) if pivot not in (source, target) else (None, None)
        if first is None or second is None:
            raise NotAvailable(f"no model from {source} to {target}")
        return second(first(texts, source, pivot), pivot, target)

    return run


Chat = Callable[[str, str], str]


def chat(url: str, name: str, transport: Transport = http, key: str = "", retries: int = 2, **patience) -> Chat:
    """A language model behind the common chat interface, as a function of (instructions, content)."""

    def ask(system: str, content: str) -> str:
        sent = {"json": {"model": name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}], "temperature": 0}, "headers": {"Authorization": f"Bearer {key}"} if key else {}}
        return patient(lambda: transport(url, sent)["choices"][0]["message"]["content"], attempts=retries + 1, **patience)

    return ask


def _instructions(source: str, target: str, form: str) -> str:
    return f"You translate from {source or 'the language of the text'} to {target}. Keep every tag like [PH0] as it is. Answer with {form} and nothing else."


def found_list(reply: str) -> list[str] | None:
    """The texts of the first JSON list in a reply."""
    try:
        items = json.loads(re.search(r"\[.*\]", reply, re.S)[0])
    except (TypeError, ValueError):
        return None
    return [str(x) for x in items] if isinstance(items, list) else None


def by_list(ask: Chat, chunk: int = ROUTED_CHUNK, keep_source: bool = True) -> Engine:
    """Chunks as JSON lists; a reply of another length leaves its texts as they are, or is a failure."""

    def run(texts: list[str], source: str, target: str) -> list[str]:
        out: list[str] = []
        for low in range(0, len(texts), chunk):
            part = texts[low : low + chunk]
            replies = found_list(ask(_instructions(source, target, f"a JSON list of {len(part)} texts"), json.dumps(part, ensure_ascii=False)))
            if replies is None or len(replies) != len(part):
                if not keep_source:
                    raise NotAvailable("the reply doesn't have a text for each of the request's")
                replies = part
            out += replies
        return out

    return run


def found_by_id(reply: str, ids: Sequence[str]) -> list[str]:
    """The texts of a JSON object in the order of ids; a missing one is an error."""
    try:
        known = json.loads(re.search(r"\{.*\}", reply, re.S)[0])
        return [str(known[i]) for i in ids]
    except (TypeError, ValueError, KeyError) as e:
        raise ValueError(f"the reply lacks a text: {e}") from e


def by_id(ask: Chat, chunk: int = LOCAL_CHUNK, context: int = 2) -> Engine:
    """Chunks as JSON objects by id, with the last translations as context. A chunk whose reply lacks a text is halved; a single text that fails is a failure."""

    def span(texts: list[str], done: list[str], low: int, high: int, source: str, target: str) -> None:
        ids = [str(k) for k in range(low, high)]
        before = [{"source": texts[k], "translation": done[k]} for k in range(max(0, low - context), low)]
        content = json.dumps({"before": before, "texts": {i: texts[int(i)] for i in ids}}, ensure_ascii=False)
        try:
            done[low:high] = found_by_id(ask(_instructions(source, target, "a JSON object of the texts' ids and translations"), content), ids)
        except ValueError as e:
            if high - low == 1:
                raise NotAvailable(str(e)) from e
            middle = (low + high) // 2
            span(texts, done, low, middle, source, target)
            span(texts, done, middle, high, source, target)

    def run(texts: list[str], source: str, target: str) -> list[str]:
        done = list(texts)
        for low in range(0, len(texts), chunk):
            span(texts, done, low, min(low + chunk, len(texts)), source, target)
        return done

    return run


def _distinct(items: list[str], without: str, n: int) -> list[str]:
    kept = dict.fromkeys(x.strip() for x in items if x.strip() and x.strip().lower() != without.strip().lower())
    return list(kept)[:n]


def alternatives(ask: Chat, text: str, target: str, n: int = 3, style: str = "", translation: str = "") -> list[str]:
    """Other translations of a text, or with a style other wordings: each once, in order, without the one that is there."""
    wish = f" in a {style} style" if style else ""
    reply = ask(f"Give {n} different translations to {target}{wish}. Answer with a JSON list of texts and nothing else.", text)
    return _distinct(found_list(reply) or [], translation, n)


def synonyms(ask: Chat, phrase: str, sentence: str, n: int = 6) -> list[str]:
    """Words for a phrase that fit its sentence."""
    return _distinct(found_list(ask(f"Give {n} phrases that could replace `{phrase}` in the text. Answer with a JSON list and nothing else.", sentence)) or [], phrase, n)


def mended(ask: Chat, text: str) -> str:
    """Recognised text with its reading errors put right; empty replies and replies that grow it too much leave it."""
    new = ask("Put right what a recogniser has misread. Change nothing else. Answer with the text only.", text).strip()
    return new if new and len(new) <= 1.5 * len(text) + 10 else text


def factory(name: str, transport: Transport = http, **settings) -> Engine:
    """An engine of a service by name."""
    makers: dict[str, Callable[..., Engine]] = {
        "google": google,
        "mymemory": mymemory,
        "libretranslate": lambda transport, base, **s: libretranslate(base, transport, **s),
        "openrouter": lambda transport, model, key="", **s: by_list(chat("https://openrouter.ai/api/v1/chat/completions", model, transport, key, **s)),
        "hosted": lambda transport, url, model, key="", **s: by_list(chat(url, model, transport, key, **s), HOSTED_CHUNK, keep_source=False),
        "local": lambda transport, model, base="http://localhost:11434", **s: by_id(chat(f"{base}/v1/chat/completions", model, transport, **s)),
    }
    if name not in makers:
        raise NotAvailable(f"no engine by the name {name}")
    return makers[name](transport, **settings)


#: A recogniser gives (text, score, polygon) of an image's bytes.
Recogniser = Callable[[bytes], list[tuple[str, float, list[tuple[float, float]]]]]


def recognised_words(images: DataFrame, chain: list[tuple[str, Recogniser]], weak: float = 0.6, share: float = 0.25) -> DataFrame:
    """(doc, page, ord, text, score, poly, engine) of images (doc, page, content) by a chain of recognisers.

    The next one is asked where the last has found nothing, or is unsure by its mean score or its share of weak words;
    the best by mean less 0.3 of that share counts, a later one only if it's better by 0.1. One that isn't installed is passed over.
    """

    def judged(words: list) -> tuple[float, float]:
        scores = [w[1] for w in words]
        return (sum(scores) / len(scores), sum(s < weak for s in scores) / len(scores)) if scores else (0.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, page, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best, used, quality = [], None, -1.0
                for name, engine in chain:
                    try:
                        words = engine(content or b"")
                    except NotAvailable:
                        continue
                    mean, low = judged(words)
                    if used is None or mean - 0.3 * low > quality + 0.1:
                        best, used, quality = words, name, mean - 0.3 * low if words else -1.0
                    if words and mean >= weak and low <= share:
                        break
                yield pa.RecordBatch.from_pydict({
                    "doc": pa.array([doc] * len(best), batch.schema.field(0).type), "page": pa.array([page] * len(best), batch.schema.field(1).type), "ord": pa.array(range(len(best)), pa.int64()), "text": pa.array([w[0] for w in best], pa.string()),
                    "score": pa.array([float(w[1]) for w in best], pa.float64()), "poly": pa.array([[{"x": float(x), "y": float(y)} for x, y in w[2]] for w in best], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), "engine": pa.array([used] * len(best), pa.string()),
                })

    kinds = {c: images.schema[c].dataType.simpleString() for c in ("doc", "page")}
    return images.select("doc", "page", "content").mapInArrow(run, f"doc {kinds['doc']}, page {kinds['page']}, ord bigint, text string, score double, poly array<struct<x:double,y:double>>, engine string")


def selected(name: str, installed: dict[str, Any], order: Sequence[str] = ()) -> Any:
    """A detector or extractor by name; `auto` is the first of an order that is installed."""
    for n in order if name == "auto" else (name,):
        if n in installed:
            return installed[n]
    raise NotAvailable(f"{name} isn't installed")
