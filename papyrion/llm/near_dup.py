"""MinHash near-duplicates with odd sketches: banded candidates, checked by parity bitmaps, confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import bitmap, dropped, in_parts, in_units, passes, runs_of, shingle_set, words_by_text, written
from papyrion.llm.graph import components

#: Samples of a signature are BANDS x ROWS. At a similarity of 0.8, a pair shares no band with a chance of (1 - 0.8**6)**36 = 1.6e-5; at 0.85 of 4e-8.
BANDS, ROWS = 36, 6
#: Bits of an odd sketch.
SKETCH_BITS = 1024
#: Standard deviations of the sketch's estimate that a candidate may lie below the limit.
SLACK = 4.5
#: Shingles multiplied at once, for bounded memory.
BLOCK = 2048
_RNG = np.random.Generator(np.random.PCG64(4))
_FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_SIGNED = "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>, bands array<bigint>"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    low = np.full(len(_FACTORS), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        np.minimum(low, (part[:, None] * _FACTORS + _SHIFTS).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall to each bit; equal samples of two sets cancel in the XOR."""
    numbered = (samples ^ (np.arange(len(samples), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    odd = np.bincount((numbered >> np.uint64(64 - int(math.log2(SKETCH_BITS)))).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """Bits in which two sketches may differ when their sets reach the threshold, with SLACK deviations to spare."""
    samples = BANDS * ROWS
    low = max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / samples))
    odds = 0.5 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples * (1 - low)))
    return math.ceil(SKETCH_BITS * odds + SLACK * math.sqrt(SKETCH_BITS * odds * (1 - odds)) / 2)


def _band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for column in samples.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = ((words, at, i) for _, part in in_parts(batch.column(1)) for words, at in [words_by_text(part)] for i in range(len(part)))
            for doc, (words, at, i) in zip(batch.column(0).to_pylist(), texts, strict=True):
                shingles = shingle_set(words[at[i] : at[i + 1]], width)
                sketch = bands = None
                digest = None
                if len(shingles):
                    samples = minhash(shingles)
                    sketch, bands, digest = odd_sketch(samples), _band_keys(samples), xxhash.xxh3_128_digest(shingles.tobytes())
                for column, value in zip(out, (doc, len(shingles), digest, sketch, bands), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "n_shingles", "digest", "sketch", "bands"])

    return run


def _sets(width: int, wanted_of):
    """(node, shingles) of the documents that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = wanted_of.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column(2).to_numpy().view(np.uint64))))
            for first, part in in_parts(batch.column(1)):
                words, at = words_by_text(part)
                sets = [shingle_set(words[at[i] : at[i + 1]], width) for i in range(len(part))]
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(digests, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["rep", "digest", "shingles"])

    return run


def full_sets(reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of the nodes (rep, digest). A bitmap of their ids keeps all other texts out before anything is hashed or shuffled."""
    probe = F.xxhash64("doc_id")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(reps.select(F.xxhash64("rep").alias("h"))))
    found = docs.where("doc_id is not null and text is not null").select("doc_id", "text", probe.alias("probe")).mapInArrow(_sets(width, wanted), "rep bigint, digest binary, shingles array<bigint>")
    return found.join(reps.select("rep", "digest"), ["rep", "digest"], "left_semi").groupBy("rep").agg(F.first("shingles").alias("shingles"))


def _linked(limit: int, percent: int):
    """Of each block's members: links between different labels, one for each two labels that it brings together.

    side 0: all members meet each other; else members of side 1 meet those of side 2. A pair must share a bucket and
    pass the sketches; then their full sets decide.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["rep"].to_numpy(), group["unit"].to_numpy()))
        unit, reps, sizes, side, labels = (group[c].to_numpy()[order] for c in ("unit", "rep", "n_shingles", "side", "label"))
        sketches, bands, sets = (group[c].to_numpy()[order] for c in ("sketch", "bands", "shingles"))
        found: list[tuple[int, int]] = []
        for low, high in runs_of(unit):
            if high - low > 1:
                found += one(*(x[low:high] for x in (reps, sizes, side, labels, sketches, bands, sets)))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def one(reps, sizes, side, labels, sketches, bands, sets):
        sketches, bands = np.stack(sketches).view(np.uint64), np.stack(bands)
        labels = np.unique(labels, return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
        marked = np.zeros(int(shingle.max()) + 1, np.int32)
        found = []
        for i in np.flatnonzero(side <= 1).tolist():
            near = (labels != labels[i]) & (reps != reps[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            near &= (np.arange(len(reps)) > i) if side[i] == 0 else (side == 2)
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1) <= limit]
            at = at[(bands[at] == bands[i]).any(axis=1)]
            if len(at):
                own = shingle[starts[i] : starts[i] + sizes[i]]
                marked[own] = 1
                if len(at) < len(reps) // 4:
                    shared = np.array([marked[shingle[starts[j] : starts[j] + sizes[j]]].sum() for j in at.tolist()])
                else:
                    shared = np.add.reduceat(marked[shingle], starts)[at]
                marked[own] = 0
                for j in at[100 * shared >= percent * (sizes[i] + sizes[at] - shared)].tolist():
                    if labels[j] != labels[i]:
                        found.append((reps[i], reps[j]))
                        labels[labels == labels[j]] = labels[i]
        return found

    return run


#: Members, and shingles of all members, that are compared in one task; larger groups are dealt to several.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 2**21


def _blocks(members: str, shingles: str):
    return F.greatest(F.ceil(F.col(members) / BLOCK_MEMBERS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _alike(a: str, b: str, limit: int, percent: int) -> Column:
    """Whether the sizes and sketches of two nodes (prefixes of their columns) let them be similar."""
    n = [F.col(f"{p}_n_shingles") for p in (a, b)]
    differing = reduce(Column.__add__, [F.bit_count(F.get(f"{a}_sketch", F.lit(k)).bitwiseXOR(F.get(f"{b}_sketch", F.lit(k)))) for k in range(SKETCH_BITS // 64)])
    return (100 * F.least(*n) >= percent * F.greatest(*n)) & (differing <= limit)


def _sketches(reps: DataFrame, name: str) -> DataFrame:
    return reps.select(F.col("rep").alias(f"{name}_rep"), F.col("n_shingles").alias(f"{name}_n_shingles"), F.col("sketch").alias(f"{name}_sketch"))


def _homes(shared: DataFrame, reps: DataFrame, limit: int, percent: int) -> DataFrame:
    """(rep, home): of the pivots whose bucket a node is in and whose sketch lets them be similar, the smallest. At most a pair for each entry is looked at."""
    ties = shared.where("rep != pivot").select("rep", "pivot").distinct()
    met = ties.join(_sketches(reps, "a"), F.col("rep") == F.col("a_rep")).join(_sketches(reps, "b"), F.col("pivot") == F.col("b_rep"))
    return met.where(_alike("a", "b", limit, percent)).groupBy("rep").agg(F.min("pivot").alias("home"))


def _within(members: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links found in blocks of each home's members; the home itself is in every block."""
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("block", F.explode(F.when(F.col("rep") == F.col("home"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    rows = dealt.withColumn("side", F.lit(0)).withColumn("label", F.col("rep"))
    return in_units(rows, "n_shingles", "home", "block").groupBy("call").applyInPandas(_linked(limit, percent), "a bigint, b bigint")


def _between(members: DataFrame, labels: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links that blocks have kept apart: of homes of several blocks, the members outside the home's largest component meet all its members."""
    parted = members.where("blocks > 1").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    most = parted.groupBy("home", "label").agg(F.count("*").alias("n")).groupBy("home").agg(F.max(F.struct("n", "label"))["label"].alias("largest"))
    minor = parted.join(most, "home").where("label != largest").drop("largest")
    sizes = minor.groupBy("home").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")).select("home", _blocks("members", "total").alias("minors"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = minor.join(sizes, "home").withColumn("x", own("minors")).withColumn("y", every("blocks")).withColumn("side", F.lit(1))
    right = parted.join(sizes, "home").withColumn("y", own("blocks")).withColumn("x", every("minors")).withColumn("side", F.lit(2))
    return in_units(left.unionByName(right), "n_shingles", "home", "x", "y").groupBy("call").applyInPandas(_linked(limit, percent), "a bigint, b bigint")


def _across(shared: DataFrame, labels: DataFrame, homes: DataFrame, reps: DataFrame, limit: int, percent: int) -> DataFrame:
    """Pairs (x, y) that share a bucket, but neither a home nor yet a component, and pass the sketches. Only buckets that hold several components are opened."""
    named = shared.select("rep", "bucket").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    open_entries = named.join(mixed, "bucket").join(homes, "rep", "left").withColumn("home", F.coalesce("home", "rep")).join(reps.select("rep", "n_shingles", "sketch"), "rep")
    a, b = (open_entries.select("bucket", *(F.col(c).alias(f"{p}_{c}") for c in ("rep", "label", "home", "n_shingles", "sketch"))) for p in "ab")
    apart = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_label") != F.col("b_label")) & (F.col("a_home") != F.col("b_home"))
    return a.join(b, "bucket").where(apart & _alike("a", "b", limit, percent)).select(F.col("a_rep").alias("x"), F.col("b_rep").alias("y")).distinct()


def _verified(percent: int):
    """Links among the pairs of each cell: rows with shingles are the cell's nodes, the others its pairs (rep, other)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, cell in group.groupby("unit", sort=False):
            nodes = cell[cell["other"].isna()]
            sets = {r: np.sort(np.asarray(x)) for r, x in zip(nodes["rep"].tolist(), nodes["shingles"].tolist(), strict=True)}
            pairs = cell[cell["other"].notna()]
            for x, y in zip(pairs["rep"].tolist(), pairs["other"].astype("int64").tolist(), strict=True):
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                    found.append((x, y))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (x, y) whose full sets are similar; sets: (rep, shingles). Nodes are dealt to blocks and a set goes once to each cell of two blocks that has a pair of it."""
    members, total = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    blocks = max(1, -(-members // BLOCK_MEMBERS), -(-total // BLOCK_SHINGLES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = pairs.select(block("x").alias("i"), block("y").alias("j"), "x", "y")
    nodes = cells.select("i", "j", F.explode(F.array("x", "y")).alias("rep")).distinct().join(sets, "rep").select("i", "j", "rep", F.lit(None).cast("bigint").alias("other"), "shingles", F.size("shingles").alias("n"))
    rows = nodes.unionByName(cells.select("i", "j", F.col("x").alias("rep"), F.col("y").alias("other"), F.lit(None).cast("array<bigint>").alias("shingles"), F.lit(1).alias("n")))
    return in_units(written(rows, "cells"), "n", "i", "j").select("unit", "call", "rep", "other", "shingles").groupBy("call").applyInPandas(_verified(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts whose sets of word shingles have a Jaccard similarity of percent/100 or more.

    Returns (doc_id, n_shingles, component_id, kept) for every row. Texts with equal sets form a class first, so copies
    never meet each other. Each band's bucket names its smallest member as pivot; the smallest pivot that a member's odd
    sketch takes for similar is its home (pairs in proportion to the rows). Members of a home meet in blocks of bounded
    size: those that share a bucket and pass the sketches are compared on full sets, but for members that a link has
    brought together; of homes of several blocks, the members outside the largest component then meet all others. At
    last the buckets that hold several components are opened, and pairs of different components and homes that pass the
    sketches are confirmed on full sets, so no link between components is lost.

    Null or empty text, or one without words: an empty set, a component of its own. Null id: kept as it is, with a
    null component. Texts of any length are taken whole. Repeated rows each return; rows that share an id are one node (the smallest text and digest stand
    for it). An empty table gives no rows. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    limit = most_differing_bits(percent / 100)
    signed = written(docs.mapInArrow(_signatures(width), _SIGNED), "signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    named = written(classes, "classes")
    one = named.groupBy("rep").agg(F.min("digest").alias("digest"))
    reps = signed.join(one, (signed.doc_id == one.rep) & (signed.digest == one.digest)).groupBy("rep").agg(*(F.first(signed[c]).alias(c) for c in ("n_shingles", "sketch", "bands")))
    reps = written(reps, "reps")
    entries = reps.select("rep", F.explode("bands").alias("bucket"))
    pivots = entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("pivot")).where("members > 1")
    shared = written(entries.join(pivots, "bucket").select("rep", "bucket", "pivot"), "shared")
    homes = written(_homes(shared, reps, limit, percent), "homes")
    members = homes.unionByName(homes.select(F.col("home").alias("rep"), "home").distinct()).join(reps, "rep")
    sizes = members.groupBy("home").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")).select("home", _blocks("members", "total").alias("blocks"))
    digests = lambda nodes: nodes.select("rep").distinct().join(one, "rep").select("rep", "digest")
    members = written(members.join(sizes, "home").join(full_sets(digests(members), docs, width), "rep"), "members")
    links = written(_within(members, limit, percent), "links")
    labels = components(links)
    if not members.where("blocks > 1").isEmpty():
        links = links.unionByName(written(_between(members, labels, limit, percent), "links"))
        labels = components(links)
    pairs = written(_across(shared, labels, homes, reps, limit, percent), "pairs")
    if not pairs.isEmpty():
        ends = pairs.select(F.explode(F.array("x", "y")).alias("rep"))
        more = written(_confirmed(pairs, written(full_sets(digests(ends), docs, width), "sets"), percent), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    dropped(members)
    classed = named.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(classed, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
