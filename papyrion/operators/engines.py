"""Translation engines behind one interface, their order, and what is done with their replies.

An engine is a function of a batch of texts. The echo and dictionary engines are whole; engines that need a network, a
model or a service are named here and raise :class:`NotAvailable`, so a chain falls through them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Engine = Callable[[list[str], str, str], list[str]]


class NotAvailable(RuntimeError):
    """The engine's service, model or library isn't here."""


def echo(texts: list[str], source: str, target: str) -> list[str]:
    return [f"[{target}] {t}" for t in texts]


def dictionary(entries: dict[str, str]) -> Engine:
    """An engine that knows some texts and fails on others."""

    def run(texts: list[str], source: str, target: str) -> list[str]:
        if missing := [t for t in texts if t not in entries]:
            raise NotAvailable(f"{len(missing)} texts aren't in the dictionary")
        return [entries[t] for t in texts]

    return run


def absent(name: str) -> Engine:
    def run(texts: list[str], source: str, target: str) -> list[str]:
        raise NotAvailable(f"engine {name} needs a service or model that isn't installed")

    return run


#: Engines by name; the last ones stand for adapters to be filled in by an installation.
ENGINES: dict[str, Engine] = {"echo": echo, **{n: absent(n) for n in ("google", "mymemory", "libretranslate", "nllb", "madlad", "opusmt", "argos", "indictrans", "openrouter", "hosted", "local", "ocr", "layout")}}


def translated(work: DataFrame, chain: list[tuple[str, Engine]], source: str, target: str, text_col: str = "text", threshold: int = 2) -> DataFrame:
    """Work with columns tgt and engine. Each batch goes down the chain until an engine takes it; one that has failed so often in a row in this task is asked last. A batch that none takes keeps null."""
    at = work.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failures = {name: 0 for name, _ in chain}
        for batch in batches:
            texts, out, used = batch.column(at).to_pylist(), None, None
            for name, engine in sorted(chain, key=lambda e: failures[e[0]] >= threshold):
                try:
                    out, used = engine(["" if t is None else t for t in texts], source, target), name
                    failures[name] = 0
                    break
                except NotAvailable:
                    failures[name] += 1
            columns = [*batch.columns, pa.array(out or [None] * len(texts), pa.string()), pa.array([used] * len(texts), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "tgt", "engine"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema)
    return work.mapInArrow(run, f"{fields}, tgt string, engine string")


def reply_by_id(reply: Column, ids: Column) -> Column:
    """Texts of a JSON object reply in the order of ids; null if the reply isn't such or lacks one."""
    found = F.transform(ids, lambda i: F.element_at(F.from_json(reply, "map<string,string>"), i))
    return F.when(F.forall(found, lambda x: x.isNotNull()), found)


def reply_list(reply: Column) -> Column:
    """The texts of the first JSON list in a reply, in order, each once."""
    return F.array_distinct(F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>"))


#: Scripts whose letters don't belong in a text for a Latin-script language.
_FOREIGN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsCyrillic}\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsThai}\p{IsHebrew}\p{IsGreek}]+"


def residual(x: Column) -> Column:
    """What is left in other scripts in a translation for a Latin-script language, each once."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(_FOREIGN), F.lit(0)))


def packed(lengths: list[int], budget: int) -> list[int]:
    """The chunk of each segment when chunks are filled up to a budget in order; a longer segment has a chunk of its own."""
    chunk, used, out = 0, 0, []
    for n in lengths:
        if used and used + n > budget:
            chunk, used = chunk + 1, 0
        used += n
        out.append(chunk)
    return out


def language_code(code: str, table: dict[str, str], engine: str) -> str:
    """An engine's code for a language; one that the engine doesn't have is an error, not a guess."""
    base = re.split("[-_]", code.lower())[0]
    if base not in table:
        raise NotAvailable(f"{engine} has no code for {code}")
    return table[base]
