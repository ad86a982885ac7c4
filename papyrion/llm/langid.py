"""Language identification by compression: the zstandard dictionary that makes a text smallest names its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The training sample: so many texts of each language, those of smallest hash in as many bins, and a piece of so many characters of each, at a place that a hash picks.
SAMPLES, SAMPLE_CHARS = 64, 2_000
#: Pieces in all: with more languages than PIECES / SAMPLES, each has fewer, down to one.
PIECES = 12_800
LEVEL, BLOCK = 6, 8_192
#: A relative gain over the second language below this is a rejection.
MARGIN = 0.02
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: int = PIECES) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null language value, from a bounded sample of its texts.

    The sample is a minimum by hash in each of SAMPLES bins, so it is the same at every partitioning and is reduced
    before the shuffle. Languages come by falling number of texts, counted over all, ties by name. Null, empty and
    repeated texts and ids do no harm, nor do columns of other names; of a very long text a piece is learned, as of any;
    no labelled text gives no languages. Every language is learned, however many there are.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    bins = max(1, min(SAMPLES, pieces // max(1, known.select(lang_col).distinct().count())))
    ticket = F.xxhash64(F.col(id_col).cast("string"), F.lit("langid"))
    places = F.greatest(F.length(text_col) - SAMPLE_CHARS + 1, F.lit(1))
    piece = F.substr(F.col(text_col), (F.pmod(F.xxhash64(F.col(text_col), F.lit("place")), places) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = known.select(F.col(lang_col).alias("lang"), F.pmod(ticket, F.lit(bins)).alias("bin"), F.struct(ticket.alias("ticket"), piece.alias("piece")).alias("s"))
    picked = rows.groupBy("lang", "bin").agg(F.min("s").alias("s"), F.count("*").alias("n")).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    counts: Counter[str] = Counter()
    for r in picked:
        texts.setdefault(r["lang"], []).append((r["s"]["ticket"], r["s"]["piece"]))
        counts[r["lang"]] += r["n"]
    return {lang: " ".join(p.lower() for _, p in sorted(own)).encode() for lang, own in sorted(texts.items(), key=lambda x: (-counts[x[0]], x[0]))}


def sizes(text: str, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text under each dictionary, in blocks so that a long text doesn't only lean on itself."""
    data = text.lower().encode()
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in coders]


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text_col: str = "text") -> DataFrame:
    """docs without the text, and lang_pred, score and rejected. score is the relative gain over the second language, 0 to 1; rejected marks a gain below the margin.

    Null, empty or letterless texts, or no learned language: ``und`` with score 0, rejected. Ties go to the
    language with most learned texts, with score 0. Rows are independent: repeated rows and null ids return as they are;
    long texts are encoded whole, block by block; an empty table gives no rows. The other columns pass through, but
    for those named like a new one, which are replaced.
    """
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "rejected")]
    source = docs.select(text_col, *others)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(held.value)
        coders = []
        for raw in held.value.values():
            trained = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            preds, scores = [], []
            for text in batch.column(0).to_pylist():
                if not text or not langs or not _LETTER.search(text):
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                ranked = sorted((size, k) for k, size in enumerate(sizes(text, coders)))
                preds.append(langs[ranked[0][1]])
                scores.append(1.0 if len(ranked) == 1 else 1 - ranked[0][0] / ranked[1][0])
            new = (pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array([s < margin for s in scores], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*others, "lang_pred", "score", "rejected"])

    schema = T.StructType([*(source.schema[c] for c in others), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fold that is never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
