"""Line dedup by an exact set-similarity join: rarity order, prefix, length and positional filters, verified Jaccard.

A line's tokens are its distinct words (A-Z lower-cased), or its distinct shingles of so many words; a line with fewer
words is one token, one without words has none and matches nothing. Lines are ordered by (doc_id, line number). Lines
with equal sets form a class. A line goes if an earlier line has a Jaccard similarity of 0.8 or more to it.

Classes that share a token of their prefixes and pass the length and positional filters are candidates. A 128-bit parity
bitmap of each set, whose XOR bounds the sets' difference from below, rules out most of them, exactly. Of its candidates
before it a class is first verified against the earliest for each token; only what isn't similar to one of these, and
has more, is then verified against all, so a group of similar lines costs in proportion to its lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import bitmap, bytes_of, dropped, hashed_words, in_parts, mixed, partitions, passes, rolled, written

WIDTH, PERCENT = 1, 80
#: Counters by hash that rank tokens by rarity: so many for any input, counting every token. Which tokens share one is a matter of cost only.
COUNTERS, SLICE = 2**20, 2**16
#: Prefix tokens that one task gets about; tokens whose counter says more are dealt to several tasks.
PART_ENTRIES = 2**20
#: Lists of classes that share a prefix token: up to the first size all pairs of many lists are looked at at once, up to the second of one list; beyond, each class meets the earliest so many.
SMALL_LIST, LARGE_LIST = 64, 4096
#: Pairs of entries that are looked at in one go, for bounded memory.
LOOKED = 2**16


def line_tokens(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column's lines with words: text number, line number in its text, and all their tokens with the line that each is of."""
    data, offsets = bytes_of(column)
    starts, _, hashes = hashed_words(data, offsets)
    ends = np.flatnonzero(data == 10) + 1
    text_of_end = np.searchsorted(offsets, ends - 1, side="right") - 1
    place = np.concatenate((offsets[:-1], ends))
    text = np.concatenate((np.arange(len(column)), text_of_end))
    order = np.lexsort((np.concatenate((np.zeros(len(column), np.int8), np.ones(len(ends), np.int8))), text))
    # a text's first line, then its others, in order; a line end that is the text's last byte opens an empty line
    place, text = place[order], text[order]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    bounds = np.searchsorted(starts, place)
    # words before the next line's place; that of a text's last line is where the next text starts
    n = np.diff(np.concatenate((bounds, [len(starts)])))
    keep = np.flatnonzero(n)
    text, number, n, first = text[keep], number[keep], n[keep], bounds[keep]
    tokens, lines = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= width:
        every = rolled(hashes, width)
        line = np.repeat(np.arange(len(n)), n)[: len(every)]
        inside = np.arange(len(every)) + width <= (first + n)[line]
        tokens, lines = every[inside], line[inside]
    for short in range(1, width):
        few = np.flatnonzero(n == short)
        if len(few):
            whole = rolled(hashes, short)[first[few]]
            tokens, lines = np.concatenate((tokens, whole)), np.concatenate((lines, few))
    return text, number, tokens, lines


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in in_parts(batch.column(1)):
                tokens = line_tokens(texts, width)[2]
                counts += np.bincount((tokens & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = [k for k in range(COUNTERS // SLICE) if counts[k * SLICE : (k + 1) * SLICE].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(at, pa.int32()), "counts": pa.array([zlib.compress(counts[k * SLICE : (k + 1) * SLICE].tobytes(), 1) for k in at], pa.binary())})

    return run


def _added(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLICE, np.int64)
    for table in tables:
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
    ranks = zlib.compress(np.log2(total + 1).astype(np.uint8).tobytes())
    yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "ranks": pa.array([ranks], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


def rarity(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """For each counter, the power of two of the number of tokens in all lines that fall to it: 1 MB, whatever the input. And how many tokens there are."""
    ranks, total = np.zeros(COUNTERS, np.uint8), 0
    sums = docs.mapInArrow(_count(width), "slice int, counts binary").groupBy("slice").applyInArrow(_added, "slice int, ranks binary, total bigint")
    for r in sums.collect():
        ranks[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["ranks"]), np.uint8)
        total += r["total"]
    return ranks, total


def _sets(tokens: np.ndarray, lines: np.ndarray, ranks: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Tokens by line in rarity order without repeats, their lines, where each line starts, its size, two hashes of its set and its parity bitmap."""
    rank = np.zeros(len(tokens), np.uint64) if ranks is None else ranks[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    # one sort brings each line's tokens into order and equal ones together: 17 bits of line, 6 of rarity, 41 of hash
    packs = int(lines.max()) < 2**17
    if packs:
        packed = (lines.astype(np.uint64) << np.uint64(47)) | (rank << np.uint64(41)) | (tokens >> np.uint64(23))
        order = np.argsort(packed)
        packed = packed[order]
        packs = not ((packed[1:] == packed[:-1]) & (tokens[order][1:] != tokens[order][:-1])).any()
    if not packs:  # a text of very many lines, or two tokens of a line that differ in their last bits only
        order = np.lexsort((tokens, tokens >> np.uint64(23), rank, lines))
    tokens, lines = tokens[order], lines[order]
    new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (lines[1:] != lines[:-1])))
    tokens, lines = tokens[new], lines[new]
    starts = np.flatnonzero(np.concatenate(([True], lines[1:] != lines[:-1])))
    n = np.diff(np.concatenate((starts, [len(lines)])))
    once = mixed(tokens)
    key = mixed(np.add.reduceat(once, starts) + n.astype(np.uint64))
    check = np.add.reduceat(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), starts)
    bit, upper = np.uint64(1) << (once & np.uint64(63)), (once >> np.uint64(63)).astype(bool)
    bits = [np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), starts) for half in (~upper, upper)]
    return tokens, lines, starts, n, key, check, bits


_CLASS = np.dtype([("key", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("line", "<i8")])
#: A prefix token of a class: place is the class's document as a float, which orders documents but for ties.
_ENTRY = {"token": np.uint64, "key": np.uint64, "low": np.uint64, "high": np.uint64, "place": np.float32, "n": np.uint32, "pos": np.uint32}


def _slices(tokens: np.ndarray, ranks: np.ndarray, part_entries: int) -> np.ndarray:
    """Into how many tasks a token's entries are dealt: one, but for tokens that may have more than a task's."""
    return np.maximum(1, 2 ** ranks[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64) // (2 * part_entries))


def _deal(ranks_of, width: int, percent: int, parts: int, part_entries: int):
    """Rows of packed arrays for each part: a batch's classes with their first line, the prefix tokens of each class, and the lines of a batch that come later than an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in in_parts(batch.column(1)):
                of_text, of_line, tokens, lines = line_tokens(texts, width)
                if len(tokens):
                    yield _packed(ids[first + of_text], of_line, tokens, lines, ranks)

    def _packed(docs, of_line, tokens, lines, ranks):
        tokens, lines, starts, n, key, check, bits = _sets(tokens, lines, ranks)
        at = lines[starts]
        doc, line = docs[at], of_line[at]
        by_key = np.lexsort((line, doc, check, key))
        leads = np.concatenate(([True], (key[by_key][1:] != key[by_key][:-1]) | (check[by_key][1:] != check[by_key][:-1])))
        one, later = by_key[leads], by_key[~leads]
        # a repeated row has lines of the same place, which are no later ones
        firsts = by_key[np.flatnonzero(leads)[np.cumsum(leads) - 1]][~leads]
        later = later[(doc[later] != doc[firsts]) | (line[later] != line[firsts])]
        classes = np.zeros(len(one), _CLASS)
        for name, value in (("key", key), ("check", check), ("doc", doc), ("line", line)):
            classes[name] = value[one]
        prefix = n - -(-percent * n // 100) + 1
        rank_in_line = np.arange(len(lines)) - np.repeat(starts, n)
        led = np.zeros(len(n), bool)
        led[one] = True
        entry = np.flatnonzero((rank_in_line < np.repeat(prefix, n)) & np.repeat(led, n))
        owner = np.repeat(np.arange(len(n)), n)[entry]
        values = {"token": tokens[entry], "key": key[owner], "low": bits[0][owner], "high": bits[1][owner], "place": doc[owner], "n": n[owner], "pos": rank_in_line[entry]}
        share = (mixed(values["key"]) % _slices(values["token"], ranks, part_entries).astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        gone = np.stack((doc[later], line[later]), axis=1)
        part_of = [(x % np.uint64(parts)).astype(np.int64) for x in (classes["key"], mixed(values["token"] + share), mixed(doc[later].view(np.uint64)))]
        sorts = [np.argsort(x, kind="stable") for x in part_of]
        own, sub, out = (x[s] for x, s in zip(part_of, sorts, strict=True))
        columns: list[list] = [[], [], [], []]
        for k in np.unique(np.concatenate(part_of)).tolist():
            x, y, z = (s[np.searchsorted(p, k) : np.searchsorted(p, k, side="right")] for p, s in ((own, sorts[0]), (sub, sorts[1]), (out, sorts[2])))
            packed = b"".join(values[c][y].astype(kind).tobytes() for c, kind in _ENTRY.items())
            for column, value in zip(columns, (k, classes[x].tobytes(), packed, gone[z].tobytes()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "classes", "entries", "gone"])

    return run


#: x is a class's key; y its check, its candidate's key, or a token; doc and line a place, or the halves of a bitmap.
_FOUND = "kind int, x bigint, y bigint, doc bigint, line bigint, n int, pos int, place float"
LATER, CLASS, PAIR, OPEN, SOUGHT = range(5)


def _rows(kind: int | np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    kinds = {"x": np.int64, "y": np.int64, "doc": np.int64, "line": np.int64, "n": np.int32, "pos": np.int32, "place": np.float32}
    made = []
    for name, type_ in kinds.items():
        value = columns.get(name)
        made.append(pa.array(np.zeros(count, type_) if value is None else np.ascontiguousarray(value).view(type_) if value.dtype.itemsize == np.dtype(type_).itemsize else value.astype(type_)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind, np.int32) if isinstance(kind, int) else kind), *made], names=["kind", *kinds])


def near(percent: int, a: tuple, b: tuple) -> np.ndarray:
    """Whether two classes (n, pos, low, high) may be similar, from a token that they share: length, positional and bitmap filter."""
    both = a[0] + b[0]
    needed = -(-percent * both // (100 + percent))
    passed = (100 * np.minimum(a[0], b[0]) >= percent * np.maximum(a[0], b[0])) & (np.minimum(a[0] - a[1], b[0] - b[1]) >= needed)
    return passed & (np.bitwise_count(a[2] ^ b[2]).astype(np.int64) + np.bitwise_count(a[3] ^ b[3]) <= both - 2 * needed)


def _meet(ranks_of, percent: int, part_entries: int, small: int, large: int):
    """Within a part: the lines that come LATER than an equal one, each CLASS and its first line, PAIRs of a class and its earliest candidate for each token, and entries of lists that hold more candidates: SOUGHT for those of a class that has more, else OPEN."""

    def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, gone, entries = [], [], {c: [] for c in _ENTRY}
        for table in tables:
            classes += [np.frombuffer(x, _CLASS) for x in table.column("classes").to_pylist()]
            gone += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("gone").to_pylist()]
            for x in table.column("entries").to_pylist():
                m, at = len(x) // sum(np.dtype(k).itemsize for k in _ENTRY.values()), 0
                for name, kind in _ENTRY.items():
                    entries[name].append(np.frombuffer(x, kind, m, at))
                    at += m * np.dtype(kind).itemsize
        rows = np.concatenate(classes)
        rows = rows[np.lexsort((rows["line"], rows["doc"], rows["check"], rows["key"]))]
        if len(rows):
            leads = np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["check"][1:] != rows["check"][:-1])))
            first = rows[np.flatnonzero(leads)[np.cumsum(leads) - 1]]
            later = rows[~leads & ((rows["doc"] != first["doc"]) | (rows["line"] != first["line"]))]
            gone.append(np.stack((later["doc"], later["line"]), axis=1))
            one = rows[leads]
            yield _rows(CLASS, x=one["key"], y=one["check"], doc=one["doc"], line=one["line"])
        if out := [g for g in gone if len(g)]:
            both = np.concatenate(out)
            yield _rows(LATER, doc=both[:, 0], line=both[:, 1])
        joined = {c: np.concatenate(v) for c, v in entries.items()}
        if len(joined["token"]):
            yield from _lists({c: v.astype(np.int64) if c in ("n", "pos") else v for c, v in joined.items()})

    def _lists(e):
        order = np.argsort(e["token"])
        token = e["token"][order]
        new = np.concatenate(([True], token[1:] != token[:-1]))
        at_list = np.cumsum(new) - 1
        several = (np.bincount(at_list)[at_list] > 1) | (_slices(token, ranks_of.value, part_entries) > 1)
        order, at_list = order[several], at_list[several].astype(np.uint64) << np.uint64(32)
        if not len(order):
            return
        # a list's entries in order of their documents
        place = e["place"][order].view(np.uint32)
        place = np.where(place >> np.uint32(31), ~place, place | np.uint32(2**31)).astype(np.uint64)
        by_place = np.argsort(at_list | place)
        order, at_list = order[by_place], at_list[by_place]
        # of one class's entries in a list, the earliest stands for it
        key = e["key"][order]
        by_key = np.argsort(at_list | (key >> np.uint64(32)))
        leads = np.concatenate(([True], (at_list[by_key][1:] != at_list[by_key][:-1]) | (key[by_key][1:] != key[by_key][:-1])))
        earliest = np.sort(np.minimum.reduceat(by_key, np.flatnonzero(leads)))
        e = {c: v[order[earliest]] for c, v in e.items()}
        token, place, key = e["token"], e["place"], e["key"]
        count = len(token)
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.concatenate((starts, [count])))
        size_of = np.repeat(sizes, sizes)
        start_of = np.repeat(starts, sizes)
        first, found = np.full(count, count), np.zeros(count, np.int64)
        used = np.zeros(count, bool)  # a candidate of a later class

        def look(i, j):
            """Entries i, each at or before its j in the list: those that pass the filters are candidates of j."""
            a, b = ([e[c][k] for c in ("n", "pos", "low", "high")] for k in (i, j))
            ok = near(percent, a, b) & (key[i] != key[j])
            i, j = i[ok], j[ok]
            # documents that floats don't tell apart may be in either order
            tied = place[i] == place[j]
            for x, y in ((i, j), (j[tied], i[tied])):
                np.add.at(found, y, 1)
                np.minimum.at(first, y, x)
                used[x] = True

        at = np.flatnonzero((size_of > 1) & (size_of <= small))
        for gap in range(1, small):
            at = at[at - gap >= start_of[at]]
            for low in range(0, len(at), LOOKED):
                part = at[low : low + LOOKED]
                look(part - gap, part)
        for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            lead = start + np.arange(min(size, large))
            step = max(1, LOOKED // len(lead))
            for low in range(start + 1, start + size, step):
                j = np.arange(low, min(low + step, start + size))
                i, j = (x.ravel() for x in np.meshgrid(lead[lead < j[-1]], j))
                look(i[i < j], j[i < j])
        # lists of which not all pairs have been looked at
        partly = (_slices(token, ranks_of.value, part_entries) > 1) | (size_of > large)
        sought = (found > 1) | partly
        at = np.flatnonzero(first < count)
        if len(at):
            x, y = key[at], key[first[at]]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            once = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            yield _rows(PAIR, x=x[once], y=y[once])
        more = np.repeat(np.logical_or.reduceat(sought, starts), sizes) & (sought | used | (found > 0))
        more = np.flatnonzero(more)
        if len(more):
            # n and pos are of a line's words, of which a task's memory holds fewer than 2**31
            yield _rows(np.where(sought[more], SOUGHT, OPEN).astype(np.int32), x=key[more], y=token[more], doc=e["low"][more], line=e["high"][more], n=e["n"][more], pos=e["pos"][more], place=place[more])

    return run


def _wanted_tokens(width: int, docs_of, keys_of):
    """(key, doc, line, tokens) of the lines that may be wanted, of the documents that may hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, keys = docs_of.value, keys_of.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column(2).to_numpy().view(np.uint64))))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in in_parts(batch.column(1)):
                of_text, of_line, tokens, lines = line_tokens(texts, width)
                if not len(tokens):
                    continue
                tokens, lines, starts, n, key, _, _ = _sets(tokens, lines, None)
                hits = np.flatnonzero(passes(keys, key))
                sets = [tokens[starts[h] : starts[h] + n[h]].view(np.int64) for h in hits.tolist()]
                at = lines[starts[hits]]
                yield pa.RecordBatch.from_arrays([pa.array(key[hits].view(np.int64)), pa.array(ids[first + of_text[at]], pa.int64()), pa.array(of_line[at], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "doc_id", "line", "tokens"])

    return run


def _similar_later(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, check) of the later class of each pair (x, y) of keys whose whole sets are similar. Classes that share a key are told apart by their check."""
    named = lambda p: sets.select(*(F.col(c).alias(f"{p}_{c}") for c in sets.columns))
    met = pairs.join(named("a"), F.col("x") == F.col("a_key")).join(named("b"), F.col("y") == F.col("b_key"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    met = met.withColumn("shared", shared).where((100 + percent) * F.col("shared") >= percent * (F.size("a_tokens") + F.size("b_tokens")))
    a, b = F.struct("a_doc_id", "a_line"), F.struct("b_doc_id", "b_line")
    later = F.when(a > b, F.struct(F.col("a_key").alias("key"), F.col("a_check").alias("check"))).when(a < b, F.struct(F.col("b_key").alias("key"), F.col("b_check").alias("check")))
    return met.select(later.alias("later")).where("later is not null").select("later.key", "later.check").distinct()


def _candidates(open_lists: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y) of the classes in left (key) that are still sought with all their candidates, by a join on the shared token under the same filters."""
    y = open_lists.select(F.col("y").alias("token"), *(F.col(c).alias(f"b_{c}") for c in ("x", "doc", "line", "n", "pos", "place")))
    x = open_lists.where(F.col("kind") == SOUGHT).join(left, F.col("x") == F.col("key"), "left_semi").select(F.col("y").alias("token"), *(F.col(c).alias(f"a_{c}") for c in ("x", "doc", "line", "n", "pos", "place")))
    both = F.col("a_n").cast("long") + F.col("b_n")
    needed = -F.floor(-percent * both / F.lit(100 + percent))
    passing = (
        (F.col("b_place") <= F.col("a_place")) & (F.col("a_x") != F.col("b_x")) & (100 * F.least("a_n", "b_n").cast("long") >= percent * F.greatest("a_n", "b_n").cast("long"))
        & (F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= needed) & (F.bit_count(F.col("a_doc").bitwiseXOR(F.col("b_doc"))) + F.bit_count(F.col("a_line").bitwiseXOR(F.col("b_line"))) <= both - 2 * needed)
    )
    return x.join(y, "token").where(passing).select(F.col("a_x").alias("x"), F.col("b_x").alias("y")).distinct()


def line_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: (doc_id long, text). Returns (classes, beaten, later).

    classes (key, check, doc_id, line): a class of lines with equal sets, by its first line. beaten (key, check): the
    classes that have a similar one before them, verified on whole sets. later (doc_id, line): lines that repeat an
    earlier line's set.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null")
    counted, total = rarity(docs, width)
    parts = max(4 * partitions(spark), -(-total * (100 - percent) // (100 * PART_ENTRIES)))
    ranks = spark.sparkContext.broadcast(counted)
    dealt = docs.mapInArrow(_deal(ranks, width, percent, parts, PART_ENTRIES), "part int, classes binary, entries binary, gone binary")
    met = written(dealt.groupBy("part").applyInArrow(_meet(ranks, percent, PART_ENTRIES, SMALL_LIST, LARGE_LIST), _FOUND), "lines")
    classes = met.where(F.col("kind") == CLASS).select(F.col("x").alias("key"), F.col("y").alias("check"), F.col("doc").alias("doc_id"), "line")
    later = met.where(F.col("kind") == LATER).select(F.col("doc").alias("doc_id"), "line")
    pairs = met.where(F.col("kind") == PAIR).select("x", "y").distinct()
    open_lists = met.where(F.col("kind") >= OPEN)
    keys = met.where(F.col("kind") == PAIR).select(F.explode(F.array("x", "y")).alias("key")).unionByName(open_lists.select(F.col("x").alias("key"))).distinct()
    wanted = written(classes.join(keys, "key", "left_semi"), "wanted")
    of_docs = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("doc_id").alias("h"))))
    of_keys = spark.sparkContext.broadcast(bitmap(wanted.select("key")))
    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("probe")).mapInArrow(_wanted_tokens(width, of_docs, of_keys), "key bigint, doc_id bigint, line bigint, tokens array<bigint>")
    # repeated rows give the same line again
    sets = written(found.join(wanted, ["key", "doc_id", "line"]).dropDuplicates(["key", "doc_id", "line"]), "tokens")
    dropped(wanted)
    beaten = written(_similar_later(pairs, sets, percent), "beaten")
    left = sets.select("key", "check").join(beaten, ["key", "check"], "left_anti").select("key")
    more = written(_similar_later(_candidates(open_lists, left, percent).join(pairs, ["x", "y"], "left_anti"), sets, percent), "beaten")
    dropped(sets)
    return classes, beaten.unionByName(more).distinct(), later


def removed_lines(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, lines array<bigint>): the numbers of the lines that go, for each document that loses any."""
    classes, beaten, later = line_classes(docs, width, percent)
    return later.unionByName(classes.join(beaten, ["key", "check"]).select("doc_id", "line")).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the text's later similar lines removed, and n_lines and n_removed_lines (long).

    Null text stays null with 0 lines; an empty text is one line without words. Null ids keep their texts. Rows that
    repeat an id and text are one document and return alike. Lines are parted by ``\\n`` only and the others stay as they
    are, so a text that loses all its lines is empty. Texts and lines of any length are taken whole. An empty table gives
    no rows; other columns pass through. Columns of docs by the names n_lines and n_removed_lines are replaced.
    """
    rows = removed_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width, percent).toDF("_removed_of", "_removed")
    joined = docs.join(rows, docs[id_col].cast("long") == rows["_removed_of"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_removed", i.cast("long"))), "\n")
    out = joined.withColumn("n_lines", F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed_lines", F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("_removed")), F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(kept))
    return out.drop("_removed_of", "_removed")
