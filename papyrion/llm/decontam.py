"""Benchmark decontamination by template: typed placeholders, a hash join of windows, and a check of the slots.

A capital that opens a sentence may be a name or not, so texts are read twice: such a word is plain in one reading and a
name in the other. An item's numbers, names and units may have been replaced, one value always by the same one; several
may have become one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import bitmap, bytes_of, hashed_words, in_parts, mixed, passes, written

#: Words of a window; an item with fewer words is one window. A window needs so many plain words, or is found word for word only.
WINDOW, PLAIN = 8, 4
#: An item is found where windows at one alignment cover so much of it, or so many words in all; where slots conflict, the others must go beyond so many.
COVERAGE, LONG_MATCH = 0.5, 13
#: Words that are units after a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg t lb oz ml l s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres percent degree degrees dollar dollars euro euros cent cents usd eur gbp".split())

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _CAPITAL | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_WITHIN = np.isin(_BYTES, list(b".,:/"))
_ENDS = np.isin(_BYTES, list(b".!?:"))
_NUM, _NAME, _UNIT = (np.uint64(k) for k in (0x9D5C1B7E3F2A6481, 0x3B1F8E6D4C2A9075, 0xC4A7E1539B0D2F68))
_UNIT_HASHES = np.sort(hashed_words(np.frombuffer(" ".join(sorted(UNITS)).encode(), np.uint8), np.array([0]))[2])


#: What a capitalised word is that opens a sentence.
PLAIN_OPENINGS, FIRST_TYPED, NO_OPENINGS = range(3)


@dataclass
class Canonical:
    """The words of some texts, one after another: letters and digits, with marks between digits; other marks are left out.

    plain are hashes of the lower-cased words; in typed, numbers (what starts with a digit), names (a capital and then
    none; a reading says what one that opens a sentence is) and units (after a number) have the hash of their kind.
    """

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    bounds: np.ndarray
    plain: np.ndarray
    typed: np.ndarray
    slot: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, reading: int = PLAIN_OPENINGS) -> Canonical:
        """reading: words that open a sentence are plain, or all but a text's first word, or none."""
        data, offsets = bytes_of(column)
        digit = _DIGIT[data]
        between = np.zeros(len(data), bool)
        between[1:-1] = digit[:-2] & digit[2:] & _WITHIN[data[1:-1]]
        between[offsets[:-1][offsets[:-1] < len(data)]] = False
        between[offsets[1:][offsets[1:] > 0] - 1] = False
        starts, stops, plain = hashed_words(data, offsets, _LETTER[data] | digit | between)
        bounds = np.searchsorted(starts, offsets)
        first = np.zeros(len(starts) + 1, bool)
        first[bounds] = True
        first = first[:-1]
        number = digit[starts]
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1] & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, plain[1:]), len(_UNIT_HASHES) - 1)] == plain[1:])
        unit &= ~first & ~number
        marks = np.concatenate(([0], np.cumsum(_ENDS[data])))
        opens = first & (reading == PLAIN_OPENINGS)
        if reading != NO_OPENINGS:
            opens[1:] |= ~first[1:] & (marks[starts[1:]] > marks[stops[:-1]])
        second = np.minimum(starts + 1, max(len(data) - 1, 0))
        name = _CAPITAL[data[starts]] & (stops - starts > 1) & ~_CAPITAL[data[second]] & ~opens & ~unit
        typed = plain.copy()
        typed[name], typed[unit], typed[number] = _NAME, _UNIT, _NUM
        return cls(data, starts, stops, bounds, plain, typed, number | unit | name)

    def windows(self, width: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the windows of so many words within a text: of the plain words where exact, else of the template, without those that have too few plain words outside slots."""
        count = len(self.plain) - width + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        loose = width - (slots[width:] - slots[:-width]) >= min(PLAIN, width)
        acc = np.full(count, np.uint64(width + 2 * WINDOW * exact))
        for j in range(width):
            acc = (acc ^ (self.plain if exact else self.typed)[j : j + count]) * np.uint64(0x9FB21C651E98DF25)
            acc ^= acc >> np.uint64(29)
        n = np.diff(self.bounds)
        inside = np.flatnonzero((np.arange(count) + width <= np.repeat(self.bounds[1:], n)[:count]) & (loose | exact))
        return inside, mixed(acc[inside])

    def values(self, at: int, width: int) -> list[str]:
        return [bytes(self.data[self.starts[k] : self.stops[k]]).decode(errors="replace").lower() for k in range(at, at + width) if self.slot[k]]


_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def low_foreign(column: pa.Array) -> pa.Array:
    """Texts with letters beyond ASCII in lower case; those of ASCII, whose capitals tell names, stay and are folded when hashed."""
    if not (bytes_of(column)[0] >= 128).any():
        return column
    return pa.array([t if t is None or t.isascii() else _FOREIGN.sub(lambda m: m[0].lower(), t) for t in column.to_pylist()], pa.string())


def _emit(wanted_of, widths_of, item: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if wanted_of is None else wanted_of.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, column in in_parts(batch.column(1)):
                column = low_foreign(column)
                texts, named = Canonical.of(column), Canonical.of(column, NO_OPENINGS)
                n = np.diff(texts.bounds)
                of_word = np.repeat(np.arange(len(n)), n)
                differ = np.concatenate(([0], np.cumsum(texts.slot != named.slot)))
                # an item's first word may stand anywhere in a sentence of a document
                readings = [(texts, False), (texts, True), (named, False), *([(Canonical.of(column, FIRST_TYPED), False)] if item else [])]
                for (read, exact), width in product(readings, range(1, WINDOW + 1) if item else widths_of):
                    at, hashes = read.windows(width, exact)
                    if read is named:  # the others are as in the first reading
                        keep = differ[at + width] > differ[at]
                        at, hashes = at[keep], hashes[keep]
                    if item:  # an item's windows have one width
                        keep = np.minimum(n[of_word[at]], WINDOW) == width
                        if read is not texts and read is not named:
                            keep &= at == texts.bounds[of_word[at]]
                    else:
                        keep = passes(wanted, hashes)
                    at, hashes = at[keep], hashes[keep]
                    if len(at):
                        text = of_word[at]
                        slots = [read.values(k, width) if item or not exact else [] for k in at.tolist()]
                        columns = (pa.array(ids[start + text], pa.int64()), pa.array(hashes.view(np.int64)), pa.array(at - texts.bounds[text], pa.int64()), pa.array(n[text], pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(np.full(len(at), exact)), pa.array(np.full(len(at), read is named)))
                        yield pa.RecordBatch.from_arrays(list(columns), names=["id", "window", "at", "words", "slots", "exact", "named"])

    return run


_WINDOWS = "id bigint, window bigint, at bigint, words bigint, slots array<string>, exact boolean, named boolean"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, window, at, words, slots, exact, named) for each window of each item with an id, as a template, word for word, and as a template in which openings of sentences are names; items without words have none."""
    source = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return source.mapInArrow(_emit(None, None, True), _WINDOWS)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage): items found in a document, possibly with other numbers, names or units.

    Windows of documents that pass a bitmap of fixed size are joined by hash to those of the benchmark. At each
    alignment of an item in a document, the slots of all joined windows must be a function: an item's value always
    becomes the same value, whether or not others become it too. Where values conflict, only windows count that hold none of them or are
    equal word for word, and they must go beyond LONG_MATCH words, as must windows that need an opening of a sentence to be a name. Coverage is the share of the item's windows found
    there. Null texts and ids, and texts without words, match nothing; very long texts are taken whole; repeated rows
    match alike; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    items = written(benchmark_windows(benchmark, text_col="text"), "items")
    widths = [r["w"] for r in items.groupBy(F.least("words", F.lit(WINDOW)).alias("w")).count().orderBy("w").collect()]
    wanted = spark.sparkContext.broadcast(bitmap(items.select("window")))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    found = source.mapInArrow(_emit(wanted, widths, False), _WINDOWS).alias("d")
    at = found.join(items.alias("b"), F.col("d.window") == F.col("b.window")).select(
        F.col("d.id").alias("doc_id"), F.col("b.id").alias("item_id"), (F.col("d.at") - F.col("b.at")).alias("offset"), F.col("b.at").alias("at"), F.col("b.words").alias("words"), F.col("b.exact").alias("exact"), (F.col("d.named") | F.col("b.named")).alias("named"),
        F.zip_with("b.slots", F.when(F.col("b.exact"), F.col("b.slots")).otherwise(F.col("d.slots")), lambda x, y: F.struct(x.alias("own"), y.alias("seen"))).alias("slots"),
    )
    aligned = at.groupBy("doc_id", "item_id", "offset").agg(F.first("words").alias("words"), F.collect_set(F.struct("at", "exact", "named", "slots")).alias("matched"))
    aligned = aligned.withColumn("slots", F.array_distinct(F.flatten("matched.slots")))
    # sorted, so that the same value twice has itself for a neighbour
    aligned = aligned.withColumn("owns", F.array_sort("slots.own"))
    twice = F.filter("owns", lambda x, i: (i > 0) & (F.get("owns", F.greatest(i - 1, F.lit(0))) == x))
    aligned = aligned.withColumn("conflicts", F.array_distinct(twice))
    places = lambda kept: F.size(F.array_distinct(F.transform(kept, lambda m: m["at"])))
    sound = F.filter("matched", lambda m: m["exact"] | ~F.arrays_overlap(m["slots"]["own"], F.col("conflicts")))
    aligned = aligned.withColumn("n", places(sound)).withColumn("plain", places(F.filter(sound, lambda m: ~m["named"])))
    windows = F.greatest(F.col("words") - WINDOW + 1, F.lit(1))
    enough = (F.size("conflicts") == 0) & ((F.col("plain") >= COVERAGE * windows) | (F.col("plain") + WINDOW - 1 >= LONG_MATCH)) | (F.col("n") + WINDOW - 1 > LONG_MATCH)
    return aligned.where(enough).groupBy("doc_id", "item_id").agg(F.max(F.col("n") / windows).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, items, coverage) for every row; items in ascending order; edge cases as in :func:`matches`."""
    by_doc = matches(docs, benchmark, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    out = rows.join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
