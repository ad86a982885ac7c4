"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest; and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers, about 200 MB, before it forgets them all; longer ones are never remembered.
MEMO_TOKENS, MEMO_BYTES = 700_000, 64
#: Keys to a bucket of the perfect hash.
BUCKET = 4


class PerfectHash:
    """Minimal perfect hash by hash and displace: each bucket of keys has a seed that sends its keys to free slots."""

    def __init__(self, keys: list[bytes]) -> None:
        self.size, self.buckets = len(keys), max(1, len(keys) // BUCKET)
        self.seeds = np.zeros(self.buckets, np.uint32)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys share a hash or the vocabulary repeats a key")
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        taken = np.zeros(self.size, bool)
        for b in np.argsort(starts[:-1] - starts[1:], kind="stable"):
            own = hashes[order[starts[b] : starts[b + 1]]]
            if not len(own):
                break
            for first in range(1, 2**31, 256):
                slots = self._slots(own[None, :], np.arange(first, first + 256, dtype=np.uint64)[:, None])
                fits = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    ranked = np.sort(slots, axis=1)
                    fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    at = int(fits.argmax())
                    self.seeds[b] = first + at
                    taken[slots[at]] = True
                    break

    def _slots(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        x = (hashes ^ (seeds * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; one that isn't in the set gets a slot of some other key."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        return self._slots(hashes, self.seeds[hashes % np.uint64(self.buckets)].astype(np.uint64))


class Codec:
    """Encoder and decoder for a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.pattern = ranks, pattern
        self.table = PerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        for key, slot in zip(ranks, self.table.slots(list(ranks)).tolist(), strict=True):
            self.keys[slot] = key
        self.ids = [ranks[k] for k in self.keys]
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.find = None  # compiled in the process that uses it

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "find": None}

    def merged(self, token: bytes) -> list[int]:
        """Merges the neighbours of lowest rank, leftmost first, until none can be merged. O(n log n) for n bytes."""
        rank, count = self.ranks.get, len(token)
        parts: list[bytes | None] = [token[i : i + 1] for i in range(count)]
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(r, i, 2) for i in range(count - 1) if (r := rank(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, left, length = pop(heap)
            own, right = parts[left], after[left]
            if own is None or right >= count or len(own) + len(parts[right]) != length:
                continue  # one of the two has been merged since
            own = parts[left] = token[left : left + length]
            parts[right] = None
            right = after[left] = after[right]
            if right < count:
                before[right] = left
                joined = own + parts[right]
                if (r := rank(joined)) is not None:
                    push(heap, (r, left, len(joined)))
            if (prior := before[left]) >= 0:
                joined = parts[prior] + own
                if (r := rank(joined)) is not None:
                    push(heap, (r, prior, len(joined)))
        return [self.ranks[p] for p in parts if p is not None]

    def _learn(self, tokens: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of tokens: by the perfect hash where the whole token is in the vocabulary, else by merging."""
        raw = [t.encode() for t in tokens]
        found = {}
        for token, data, slot in zip(tokens, raw, self.table.slots(raw).tolist(), strict=True):
            found[token] = (self.ids[slot],) if self.keys[slot] == data else tuple(self.merged(data))
        return found

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null counts as empty."""
        find = self.find = self.find or regex.compile(self.pattern).findall
        out = []
        for text in texts:
            tokens = find(text) if text else []
            if missing := list(set(tokens).difference(self.memo)):
                if len(self.memo) > MEMO_TOKENS:
                    self.memo.clear()
                    missing = list(set(tokens))
                self.memo.update(self._learn(missing))
            out.append(list(chain.from_iterable(map(self.memo.__getitem__, tokens))))
            for token in missing:
                if len(token) > MEMO_BYTES:
                    del self.memo[token]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; an id that the vocabulary lacks is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _mapped(codec, docs: DataFrame, columns: list[str], made: Callable[[Codec, list], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *made(own, batch.column(1).to_pylist())], names=["doc_id", *names])

    return docs.select(*columns).mapInArrow(run, schema)


def shared_codec(spark: SparkSession, path: str, pattern: str):
    """The codec as a broadcast: its size is that of the vocabulary, whatever the texts."""
    return spark.sparkContext.broadcast(Codec.load(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts, without special tokens. Null or empty text: no ids.

    Rows are independent, so repeated rows and null ids return as they are; an empty table gives no rows and other
    columns are not read. Very long texts are encoded whole: a pre-token of n bytes costs n log n.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = lambda codec, texts: [pa.array(codec.encode_all(texts), pa.list_(pa.int32()))]
    return _mapped(shared_codec(docs.sparkSession, path, pattern), source, ["doc_id", "text"], made, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>", ["ids"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text binary) of a table from :func:`encode`; null ids give null."""
    made = lambda codec, rows: [pa.array([None if x is None else codec.decode(x) for x in rows], pa.binary())]
    return _mapped(shared_codec(encoded.sparkSession, path, pattern), encoded, ["doc_id", "ids"], made, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text binary", ["text"])


def _digests(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
    counts, of_ids, of_bytes = [], [], []
    for text in texts:
        (ids,) = codec.encode_all([text])
        counts.append(len(ids))
        of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, decodes the ids and returns (doc_id, n_tokens, ids_sha256, decoded_sha256); edge cases as in :func:`encode`."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {source.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(shared_codec(docs.sparkSession, path, pattern), source, ["doc_id", "text"], _digests, schema, ["n_tokens", "ids_sha256", "decoded_sha256"])
