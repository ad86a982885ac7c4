"""Quality rules as a short-circuit cascade: rules that reject most for their cost, as a sample shows, come first."""

from __future__ import annotations

import re
import string
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import WordHashes, rolled

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Texts that each task samples from its first batch, by smallest hash, to estimate cost and selectivity; the verdict doesn't depend on it.
SAMPLE_TEXTS = 16


@dataclass
class Measured:
    """A text with its base counts; what a rule needs beyond them is made when a rule asks for it."""

    text: str
    words: list[bytes]
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_lines: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    memo: dict = field(default_factory=dict)

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def repeat_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of so many words found twice or more in the text."""
    if len(hashes) <= width:
        return 0
    windows = rolled(hashes, width)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for j in range(width):
        covered[j : j + len(windows)] |= twice
    return int(covered.sum())


def measure(text: str | None, memo: WordHashes) -> Measured:
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else [data] * bool(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return Measured(text, words, len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(memo.of(words)))


#: A rule says whether it rejects a text that has passed the base limits.
Rule = Callable[[Measured], bool]


_UPPER, _LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()
_ALNUM = _LETTERS + string.digits.encode()
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def _capitals(m: Measured) -> bool:
    data = m.text.encode()
    foreign = "" if len(data) == len(m.text) else "".join(_FOREIGN.findall(m.text))
    upper = len(data) - len(data.translate(None, _UPPER)) + sum(map(str.isupper, foreign))
    letters = len(data) - len(data.translate(None, _LETTERS)) + sum(map(str.isalpha, foreign))
    return upper > 0.5 * letters


def _marks_only(m: Measured) -> bool:
    # most words hold an ASCII letter or digit, which is cheap to see
    unclear = [w for w in m.words if len(w.translate(None, _ALNUM)) == len(w)]
    return 2 * sum(1 for w in unclear if w.isascii() or not any(map(str.isalnum, w.decode(errors="replace")))) > m.n_words


def _one_word(m: Measured) -> bool:
    return 100 * Counter(m.words).most_common(1)[0][1] > 30 * m.n_words


#: Each rule of the default cascade and its name.
RULES: dict[str, Rule] = {
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words,
    "dup_lines": lambda m: m.n_dup_lines >= 3 and 10 * m.n_dup_lines > 3 * m.n_lines,  # one line twice in a short text is no sign
    "exclaimed": lambda m: 10 * m.text.count("!!") > m.n_words,
    "capitals": _capitals,
    "marks_only": _marks_only,
    "one_word": _one_word,
}


def ordered(docs: DataFrame, rules: dict[str, Rule], text_col: str = "text", texts: int = SAMPLE_TEXTS) -> list[str]:
    """Names of the rules by rejections per second of cost on a sample, best first; ties by name.

    Every task reads its first batch and takes a few of its texts, so the sample is spread over the table and costs a
    batch for each task. The executors time the rules; their sums are added before the driver gets a row for each rule.
    With no text to sample the order is that of the names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, spent, rejected = WordHashes(), Counter(), Counter()
        for batch in batches:
            drawn = sorted(batch.column(0).to_pylist(), key=lambda x: xxhash.xxh64_intdigest((x or "").encode()))[:texts]
            seen = [m for x in drawn if not (m := measure(x, memo)).base_failed]
            for name, rule in rules.items():
                began = time.perf_counter()
                rejected[name] += sum(map(rule, seen))
                spent[name] += time.perf_counter() - began
            break
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "s": [float(spent[n]) for n in rules], "n": [int(rejected[n]) for n in rules]})

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "rule string, s double, n bigint").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    gain = {r["rule"]: r["n"] / max(r["s"], 1e-9) for r in sums}
    return sorted(rules, key=lambda name: (-gain.get(name, 0.0), name))


def score(docs: DataFrame, rules: dict[str, Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    A row that fails the base limits is rejected without any rule; else rules run in the order of :func:`ordered` until
    one rejects. kept is the same in every order. Null or empty text has no words and fails. Long texts are measured
    whole; repeated rows and null ids return as they are; an empty table gives no rows; other columns are not read.
    """
    rules = RULES if rules is None else rules
    cascade = [rules[name] for name in ordered(docs, rules, text_col)]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                m = measure(text, memo)
                failed = m.base_failed
                rows.append((*(getattr(m, c) for c in counts), failed, not failed and not any(rule(m) for rule in cascade)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *counts, "base_failed", "kept"])

    schema = ", ".join([f"doc_id {source.schema[0].dataType.simpleString()}", *(f"{c} bigint" for c in counts), "base_failed boolean", "kept boolean"])
    return source.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, rules: dict[str, Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all columns of docs; edge cases as in :func:`score`."""
    rules = RULES if rules is None else rules
    cascade = [rules[name] for name in ordered(docs, rules, text_col)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            seen = (measure(x, memo) for x in batch.column(at).to_pylist())
            yield batch.filter(pa.array([not m.base_failed and not any(rule(m) for rule in cascade) for m in seen], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
