"""What the operators of this subpackage share: the shared folder, word hashing and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words remembered by a worker before its memo is emptied; bounds the memory, not the words.
MEMO_WORDS = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only a local session without one gets a temporary folder; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = kept or tempfile.mkdtemp(prefix="papyrion-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/papyrion/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table from :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words; a memo, emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of so many neighbours; order counts."""
    count = len(hashes) - width + 1
    acc = np.full(count, np.uint64(0x9E3779B97F4A7C15 + width & 0xFFFFFFFFFFFFFFFF))
    for j in range(width):
        acc = (acc ^ hashes[j : j + count]) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
    return mixed(acc)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of one text; with fewer words the whole sequence is one; empty without words."""
    if not len(hashes):
        return hashes
    return np.unique(rolled(hashes, min(width, len(hashes))))


_MULTIPLIER = 0x9FB21C651E98DF25
_BLOCK = 2**18
_WORD = np.ones(256, bool)
_WORD[list(b" \t\n\x0b\x0c\r")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the multiplier and of its inverse, as many as the longest block has needed."""

    up = _powers(_MULTIPLIER, 2 * _BLOCK)
    down = _powers(pow(_MULTIPLIER, -1, 2**64), 2 * _BLOCK)

    @classmethod
    def of(cls, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(cls.up):
            cls.up, cls.down = _powers(_MULTIPLIER, 2 * count), _powers(pow(_MULTIPLIER, -1, 2**64), 2 * count)
        return cls.up[:count], cls.down[:count]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts of an Arrow column, where each text starts, and the end); null counts as empty."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _long_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word, as :func:`hashed_words` has it, in memory that does not follow the word's length."""
    total, shift, step = 0, 1, pow(_MULTIPLIER, _BLOCK, 2**64)
    for at in range(0, len(data), _BLOCK):
        part = data[at : at + _BLOCK]
        total += shift * int(((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _Powers.of(len(part))[0]).sum())
        shift = shift * step & 0xFFFFFFFFFFFFFFFF
    return mixed(np.array([(total + len(data)) & 0xFFFFFFFFFFFFFFFF], np.uint64))


def hashed_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of some texts starts and ends, and its 64-bit hash with A-Z lower-cased.

    Words are ``[^\\x20\\x09-\\x0D]+``, or runs of the bytes that are marked in word. A word's hash is a polynomial over its
    bytes, taken from running sums over a block of texts, so no word becomes a Python object. Blocks end between
    words; a word ends where its text does.
    """
    starts, stops, hashes, begin = [], [], [], 0
    word = _WORD[data] if word is None else word
    firsts = np.unique(offsets)
    while begin < len(data):
        end = min(begin + _BLOCK, len(data))
        while end < len(data):  # on to the next place between words
            more = word[end : end + 4096]
            gap = not more.all()
            stop = end + int(more.argmin() if gap else len(more))
            text = firsts[np.searchsorted(firsts, end)]
            end = min(stop, int(text))
            if gap or end == text:
                break
        if end - begin > 2 * _BLOCK:  # a long word, taken by itself and in pieces
            spaces = np.flatnonzero(~word[begin : begin + _BLOCK])
            first = max(int(firsts[np.searchsorted(firsts, begin + _BLOCK) - 1]), begin + (int(spaces[-1]) + 1 if len(spaces) else 0))
            if first <= begin:
                starts.append(np.array([begin]))
                stops.append(np.array([end]))
                hashes.append(_long_word(data[begin:end]))
                begin = end
                continue
            end = first
        part, own = data[begin:end], word[begin:end]
        edge = np.zeros(len(part) + 1, bool)
        inside = firsts[np.searchsorted(firsts, begin) : np.searchsorted(firsts, end, side="right")] - begin
        edge[inside] = True
        edge[0] = edge[-1] = True
        low = np.flatnonzero(own & (edge[:-1] | np.concatenate(([True], ~own[:-1]))))
        high = np.flatnonzero(own & (edge[1:] | np.concatenate((~own[1:], [True])))) + 1
        up, down = _Powers.of(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        hashes.append(mixed((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64)))
        starts.append(low + begin)
        stops.append(high + begin)
        begin = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(stops), np.concatenate(hashes)


#: Bytes of text handled at once by a worker, but for a single text that is longer.
PART_BYTES = 2**21


def in_parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """A column's texts in runs of about PART_BYTES bytes, with the number of the first."""
    at, total = 0, 0
    for i, size in enumerate(np.diff(bytes_of(texts)[1]).tolist()):
        if total and total + size > PART_BYTES:
            yield at, texts.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(texts):
        yield at, texts.slice(at)


def words_by_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of a column of texts, where each text's words start, and the end)."""
    data, offsets = bytes_of(column)
    starts, _, hashes = hashed_words(data, offsets)
    return hashes, np.searchsorted(starts, offsets)


#: Bits of a bitmap for each of its hashes, and at most; beyond, more passes it to the join that decides.
BITS, MOST_BITS = 64, 2**27


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Which values, modulo its size, occur in a table's only column of longs; made on the executors by OR, of a size fixed by MOST_BITS.

    A filter that passes all the table's values and few others, small enough for every worker.
    """
    (name,) = hashes.columns
    count, bits = hashes.count(), 2**13
    while bits < min(BITS * count, MOST_BITS):
        bits *= 2
    low = hashes.select(F.col(name).bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = low.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    found = words.toArrow()  # 32 MB at most
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint8)


def passes(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some uint64 hashes a :func:`bitmap` lets through."""
    bit = hashes & np.uint64(len(filter_bits) * 8 - 1)
    return (filter_bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Rows, and list elements, that one call of a grouped function is to get about.
CALL_ROWS, CALL_ELEMENTS = 8192, 2**22


def in_units(rows: DataFrame, elements: str, *unit: str) -> DataFrame:
    """rows with columns unit, a hash of the named columns, and call, of which each has many whole units.

    Grouping by call spares a call of a Python function for each small unit. The number of calls follows the rows and
    the sum of column elements, so a call stays about as large at any size; rows must be a table that is cheap to read.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(elements), F.lit(0))).first()
    calls = max(1, -(-n // CALL_ROWS), -(-total // CALL_ELEMENTS))
    return rows.withColumn("unit", F.xxhash64(*unit)).withColumn("call", F.pmod(F.col("unit"), F.lit(calls)))


def runs_of(unit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.zeros(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True))
