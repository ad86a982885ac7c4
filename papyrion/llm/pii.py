"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a trained span classifier decides.

Base spans (e-mail, ip, card, phone) follow fixed patterns and always stay. The method adds spans of three kinds: `secret`
(keys, tokens, passwords), `iban` and `id_number`. Candidates are wide patterns; regex, gazetteer and context labelers
vote on each for, against or not at all. The counts of all vote patterns over the whole corpus are what EM sees, so its
reliabilities hold for all rows; a logistic classifier is then fitted to the candidates of a bounded sample, weighted by
EM's posteriors, and takes each candidate of every text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "id_number", "secret")
#: The contract's patterns. (A start within a run of digits finds nothing that its first digit does not.)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """As a leftmost search of local part, @ and domain would find them, but from each @, so that long runs cost their length once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """The contract's spans by kind, each kind for itself; code points, end exclusive."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


#: Words of the gazetteer, and words that name what follows them.
GAZETTEER = frozenset("AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk- sk_live_ sk_test_ pk_live_ rk_live_ xoxb- xoxp- xoxa- AIza ya29. eyJ npm_ SG. hf_ dop_v1_ shpat_".split())
IBAN_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
CONTEXT = {
    "secret": re.compile(r"(?i)(password|passwd|pwd|passwort|contraseña|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key)[\"']?\s*(?:is|=|:|=>)?\s*[\"']?\Z"),
    "iban": re.compile(r"(?i)(iban|konto|account|cuenta|compte)\W*\Z"),
    "id_number": re.compile(r"(?i)(ssn|social security|passport|ausweis|dni|nif|nir|tax id|steuer-?id|national id)[\w .]{0,12}\W*\Z"),
}
_CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9_@./+-])(?:(?=[A-Za-z0-9_+/.-]*[0-9])(?=[A-Za-z0-9_+/.-]*[A-Za-z])[A-Za-z0-9_+/-][A-Za-z0-9_+/.-]{10,}[A-Za-z0-9_+/-]=*)(?![A-Za-z0-9@])|(?<==)[^\s\"'=<>|]{6,}|(?<==\")[^\s\"]{6,}(?=\")"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "id_number": re.compile(r"\b(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}[A-Z]|[A-Z][0-9]{8})\b"),
}
_LATIN = re.compile(r"[A-Za-z]")


def _may(text: str) -> bool:
    """What any candidate holds: a digit and a letter, digits with a hyphen, or an equals sign. Texts without are passed over."""
    return "=" in text or _DIGIT.search(text) is not None and ("-" in text or _LATIN.search(text) is not None)


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    value: str
    before: str


def candidates(text: str, base: dict[str, list[Span]] | None = None) -> list[Candidate]:
    """Spans that may be personal data of an added kind, without those that base spans (found here where not given) touch."""
    if not _may(text):
        return []
    taken = [s for spans in (base_spans(text) if base is None else base).values() for s in spans]
    out = []
    for kind, pattern in _CANDIDATES.items():
        for m in pattern.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in ".,;":
                end -= 1
            if end > start and not any(s < end and start < e for s, e in taken):
                out.append(Candidate(kind, start, end, text[start:end], text[max(0, start - 32) : start]))
                taken.append((start, end))
    return out


def entropy(value: str) -> float:
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _regex_vote(c: Candidate) -> int:
    if c.kind == "iban":
        return 1 if _iban_ok(c.value) else -1
    if c.kind == "id_number":
        return 1 if re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|[0-9]{8}[A-Z]", c.value) else -1
    return 1 if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{16,}|[A-Za-z0-9_-]{20,}", c.value) else 0


def _gazetteer_vote(c: Candidate) -> int:
    if c.kind == "iban":
        return 1 if c.value[:2] in IBAN_COUNTRIES else -1
    return 1 if c.kind == "secret" and any(c.value.startswith(p) for p in GAZETTEER) else 0


def _context_vote(c: Candidate) -> int:
    return 1 if CONTEXT[c.kind].search(c.before) else 0


def _shape_vote(c: Candidate) -> int:
    if c.kind != "secret":
        return 0
    e = entropy(c.value)
    return 1 if e >= 3.0 and re.search(r"[0-9]", c.value) else -1 if e < 2.5 else 0


def _prose_vote(c: Candidate) -> int:
    """Against what looks like a word, a version, a date or a path rather than a key."""
    return -1 if re.fullmatch(r"[A-Za-z]+[0-9]{0,3}|v?[0-9]+([.-][0-9]+)+|[0-9]+[A-Za-z]{1,3}|(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]*|[A-Za-z]+(?:-[A-Za-z0-9]+)+", c.value) else 0


#: Labelers give 1 (personal data), -1 (not) or 0 (abstain).
LABELERS: dict[str, Callable[[Candidate], int]] = {"regex": _regex_vote, "gazetteer": _gazetteer_vote, "context": _context_vote, "shape": _shape_vote, "prose": _prose_vote}


def votes(c: Candidate) -> tuple[int, ...]:
    return tuple(f(c) for f in LABELERS.values())


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """EM over counted vote patterns: prior, P(vote | class) as [class][labeler][vote + 1], and each pattern's posterior.

    Labelers are taken as independent given the class; the start is the majority's. One pseudo-count keeps a labeler
    that never erred from being infallible.
    """
    if not patterns:
        return 0.5, np.full((2, len(LABELERS), 3), 1 / 3), {}
    keys = sorted(patterns)
    grid, weight = np.array(keys), np.array([patterns[k] for k in keys], float)
    post = np.clip(0.5 + 0.3 * grid.sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        theta = np.empty((2, grid.shape[1], 3))
        for cls, p in ((0, 1 - post), (1, post)):
            for v in (-1, 0, 1):
                theta[cls, :, v + 1] = ((grid == v) * (weight * p)[:, None]).sum(axis=0) + 1
        theta /= theta.sum(axis=2, keepdims=True)
        prior = float((weight @ post + 1) / (weight.sum() + 2))
        score = np.log(theta[:, np.arange(grid.shape[1])[None, :], grid + 1]).sum(axis=2) + np.log([[1 - prior], [prior]])
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return prior, theta, dict(zip(keys, post.tolist(), strict=True))


def features(c: Candidate) -> np.ndarray:
    """What the classifier sees of a span: its kind, the votes, its shape."""
    v, n = c.value, len(c.value)
    share = lambda f: sum(map(f, v)) / n
    shape = [min(n, 64) / 64, entropy(v) / 6, share(str.isdigit), share(str.isupper), share(str.islower), share(lambda x: not x.isalnum())]
    return np.array([1.0, *(float(c.kind == k) for k in ADDED), *(float(x == s) for x in votes(c) for s in (-1, 1)), *shape])


@dataclass
class SpanModel:
    """A logistic classifier of candidates."""

    weights: np.ndarray
    posteriors: dict[tuple[int, ...], float]

    def probability(self, c: Candidate) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(c) @ self.weights, -50, 50))))


#: Candidates that the classifier is fitted to, at most; EM has no such bound.
FIT_CANDIDATES = 4_000


def _scan(column: int):
    """(pattern, n, fitted): how often each vote pattern occurs in a batch, and the features of a few by smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(column).to_pylist():
                counts.update((votes(c), tuple(features(c).tolist())) for c in (candidates(text) if text else ()))
            # one row for each pattern and shape; equal candidates weigh as often as they occur
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([list(k[0]) for k in keys], pa.list_(pa.int64())), pa.array([list(k[1]) for k in keys], pa.list_(pa.float64())), pa.array([counts[k] for k in keys], pa.int64())], names=["votes", "x", "n"])

    return run


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Counts all votes of the corpus, runs EM on the counts, and fits the classifier to a bounded sample weighted by the posteriors.

    The driver gets a row for each vote pattern (3 to the number of labelers at most) and FIT_CANDIDATES rows of features.
    """
    seen = docs.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(_scan(0), "votes array<bigint>, x array<double>, n bigint").groupBy("votes", "x").agg(F.sum("n").alias("n"))
    seen = seen.persist()
    patterns = {tuple(r["votes"]): r["n"] for r in seen.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    _, _, posteriors = reliabilities(patterns)
    sample = seen.withColumn("ticket", F.xxhash64("votes", "x")).orderBy("ticket", "x").limit(FIT_CANDIDATES).collect()
    seen.unpersist()
    size = len(features(Candidate("secret", 0, 1, "x", "")))
    weights = np.zeros(size)
    if sample:
        x = np.array([r["x"] for r in sample])
        y = np.array([posteriors[tuple(r["votes"])] for r in sample])
        w = np.sqrt(np.array([r["n"] for r in sample], float))
        w /= w.sum()
        ridge = np.eye(size) * 1e-3
        for _ in range(25):  # Newton steps of the weighted, slightly ridged logistic loss
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
            weights = weights - np.linalg.solve(hessian, x.T @ (w * (p - y)) + ridge @ weights)
    return SpanModel(weights, posteriors)


def joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in sorted(spans.get(k, [])))


def all_spans(text: str | None, model: SpanModel) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base spans with those the method adds."""
    if not text:
        return {}, {}
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    for c in candidates(text, base):
        if model.probability(c) >= 0.5:
            every.setdefault(c.kind, []).append((c.start, c.end))
    return base, every


def find(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; the model is fitted to docs where none is given.

    A candidate of probability one half counts. Null and empty texts have no spans; long texts are searched whole; repeated rows and null ids return as they are; an
    empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model or fit(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, own)
                for column, k in zip(counts, KINDS, strict=True):
                    column.append(len(base.get(k, ())))
                digests.append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                spans.append(joined(every, KINDS + ADDED))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")
