"""Scores of a hypothesis against a reference."""

from __future__ import annotations

import difflib
import math
from collections import Counter, defaultdict
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS, BETA = 6, 2.0


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """A4: character error rate; an empty reference is 0 against an empty hypothesis, else 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(hypothesis, reference) / F.length(reference))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two sequences of words, of any length and any number of distinct words.

    A column of the table of distances is held as two integers whose bits tell where it rises and where it falls, so a
    word of b costs a few operations on integers of len(a) bits.
    """
    if not a:
        return len(b)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    equal: dict[str, int] = {}
    for w in places.keys() & set(b):
        bits = bytearray(len(a) // 8 + 1)
        for i in places[w]:
            bits[i >> 3] |= 1 << (i & 7)
        equal[w] = int.from_bytes(bits, "little")
    full = (1 << len(a)) - 1
    top, rises, falls, distance = len(a) - 1, full, 0, len(a)
    for w in b:
        same = equal.get(w, 0)
        across = same | falls
        down = (((same & rises) + rises) ^ rises) | same
        up, back = falls | ~(down | rises) & full, rises & down
        distance += (up >> top & 1) - (back >> top & 1)
        up, back = (up << 1 | 1) & full, back << 1 & full
        rises, falls = back | ~(across | up) & full, up & across
    return distance


def _word_errors(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    rates = []
    for r, h in zip(reference, hypothesis, strict=True):
        if r is None or h is None:
            rates.append(None)
            continue
        a, b = r.split(), h.split()
        rates.append(edit_distance(a, b) / len(a) if a else float(bool(b)))
    return pd.Series(rates, dtype="float64")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """A5: word error rate of each pair, in Arrow batches; without reference words 0 against none, else 1."""
    return F.pandas_udf(_word_errors, "double")(reference, hypothesis)


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1 - edit_distance(list(x), list(y)) / max(len(x), len(y)) if len(x) or len(y) else 1.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance of two arrays of tokens over the longer's length, in Arrow batches; two empty ones are alike."""
    return F.pandas_udf(_similarities, "double")(a, b)


def chrf_score(reference: str, hypothesis: str) -> float:
    """Mean of the F-scores of the character n-gram orders that both texts have, 0 to 100."""
    reference, hypothesis, scores = reference.lower(), hypothesis.lower(), []
    for n in range(1, ORDERS + 1):
        if len(reference) < n or len(hypothesis) < n:
            continue
        ref = Counter(reference[i : i + n] for i in range(len(reference) - n + 1))
        hyp = Counter(hypothesis[i : i + n] for i in range(len(hypothesis) - n + 1))
        shared = (ref & hyp).total()
        precision, recall = shared / hyp.total(), shared / ref.total()
        scores.append((1 + BETA**2) * precision * recall / (BETA**2 * precision + recall) if shared else 0.0)
    return 100 * sum(scores) / len(scores) if scores else 0.0


def _chrf(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([chrf_score(r or "", h or "") for r, h in zip(reference, hypothesis, strict=True)], dtype="float64")


def chrf(reference: Column, hypothesis: Column) -> Column:
    """A2: chrF of each pair, in Arrow batches: counting n-grams where the pair lies moves no rows, unlike exploding them."""
    return F.pandas_udf(_chrf, "double")(reference, hypothesis)


def lexical_ratio(query: Column, candidate: Column, least: float = 0.0) -> Column:
    """Matching-blocks ratio of two normalised strings (asymmetric), 0 if either is empty; Arrow-batched. Pairs whose lengths and characters bound the ratio below least get that bound, unmatched."""

    def one(q: str | None, c: str | None) -> float:
        if not q or not c:
            return 0.0
        matcher = difflib.SequenceMatcher(None, q, c)
        for bound in (matcher.real_quick_ratio, matcher.quick_ratio):
            if least and bound() < least:
                return bound()
        return matcher.ratio()

    def run(queries: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series([one(q, c) for q, c in zip(queries, candidates, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(query, candidate)


_adds = itemgetter(0)


class Blocks:
    """Matching blocks of many texts with one candidate, as many characters as difflib.SequenceMatcher(None, text, candidate) matches.

    A box (a stretch of the text by one of the candidate) is searched for its longest run of equal characters, which is
    lengthened by popular ones, and leaves a box before and one after it. From :data:`POPULAR_FROM` characters on, those
    that make over a hundredth of the candidate are popular and begin no run, so the few others are looked at one by one.
    In a shorter candidate all places of a box are bits of one integer, a row for each character of the text: shifted by
    a row and a place and met with itself, those stay that end a run one longer.
    """

    #: As in difflib.
    POPULAR_FROM = 200

    def __init__(self, candidate: str) -> None:
        self.candidate, n = candidate, len(candidate)
        places: dict[str, list[int]] = {}
        for j, char in enumerate(candidate):
            places.setdefault(char, []).append(j)
        self.sparse = n >= self.POPULAR_FROM
        self.places = {char: js for char, js in places.items() if len(js) <= n // 100 + 1} if self.sparse else places
        if not self.sparse:
            self.wide = n // 8 + 1  # bytes of a row; its last bit is always free
            self.rows = defaultdict(lambda blank=bytes(self.wide): blank, ((char, sum(1 << j for j in js).to_bytes(self.wide, "little")) for char, js in places.items()))
            self.n_firsts, self.firsts = 0, 0

    def matched(self, text: str, need: int = 0) -> int | None:
        """Characters in matching blocks, None as soon as they can't be as many as are needed."""
        candidate = self.candidate
        if self.sparse:
            own = [(i, self.places[char]) for i, char in enumerate(text) if char in self.places]
        else:
            bits = int.from_bytes(b"".join(map(self.rows.__getitem__, text)), "little")
            if self.n_firsts < len(text):
                self.n_firsts, self.firsts = len(text), int.from_bytes((b"\1" + bytes(self.wide - 1)) * len(text), "little")
        most = min(len(text), len(candidate))  # of the total with what the open boxes can add, at most their shorter sides
        boxes = [(most, 0, len(text), 0, len(candidate), own if self.sparse else None)]
        total = 0
        while boxes:
            # the box that can add most goes first, as it lowers the bound most
            adds, a0, a1, b0, b1, own = boxes.pop(boxes.index(max(boxes, key=_adds)) if len(boxes) > 1 and need else -1)
            most -= adds
            i, j, k = self._sparse(own, a0, b0, b1) if self.sparse else self._dense(bits, a0, a1, b0, b1)
            while i > a0 and j > b0 and text[i - 1] == candidate[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < a1 and j + k < b1 and text[i + k] == candidate[j + k]:
                k += 1
            if k:
                total += k
                most += k
                for x0, x1, y0, y1 in ((a0, i, b0, j), (i + k, a1, j + k, b1)):
                    if x0 == x1 or y0 == y1:
                        continue
                    inner = None
                    if self.sparse:
                        inner = [x for x in own if x0 <= x[0] < x1 and any(y0 <= y < y1 for y in x[1])]
                        if not inner:  # no run begins here: only what the start has in common matches
                            while x0 < x1 and y0 < y1 and text[x0] == candidate[y0]:
                                x0, y0, total, most = x0 + 1, y0 + 1, total + 1, most + 1
                            continue
                    adds = min(x1 - x0, y1 - y0)
                    boxes.append((adds, x0, x1, y0, y1, inner))
                    most += adds
            if most < need:
                return None
        return total

    def _sparse(self, own: list[tuple[int, list[int]]], a0: int, b0: int, b1: int) -> tuple[int, int, int]:
        best, before, runs = (a0, b0, 0), -2, {}
        for i, js in own:
            last, runs = runs if before == i - 1 else {}, {}
            before = i
            for j in js:
                if b0 <= j < b1:
                    k = runs[j] = last.get(j - 1, 0) + 1
                    if k > best[2]:
                        best = i - k + 1, j - k + 1, k
        return best

    def _dense(self, bits: int, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        row = 8 * self.wide
        firsts = self.firsts >> (self.n_firsts - a1 + a0) * row
        ends = bits >> a0 * row & (firsts << b1) - (firsts << b0)
        if not ends:
            return a0, b0, 0
        k = 1
        while longer := ends & ends << row + 1:
            ends, k = longer, k + 1
        i, j = divmod((ends & -ends).bit_length() - 1, row)
        return a0 + i - k + 1, j - k + 1, k


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, within 0 to 1."""
    dot = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def bleu_from_counts(matches: list[int], totals: list[int], ref_len: int, hyp_len: int) -> float:
    """Corpus BLEU from clipped matches by order, with the brevity penalty; 0 where an order has no match."""
    if not hyp_len or not all(matches) or not all(totals):
        return 0.0
    mean = sum(math.log(m / t) for m, t in zip(matches, totals, strict=True)) / len(matches)
    return 100 * math.exp(mean + min(0.0, 1 - ref_len / hyp_len))
