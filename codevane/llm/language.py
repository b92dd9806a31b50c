"""Language identification with bit-sliced Bloom filters of n-grams.

The filters of all languages share their hash positions: position p holds one
bit for each language.  The bitwise and of an n-gram's positions is the set of
languages that have it, all found at once.  A text's counts for each language
are corrected for the filter's false positives; the largest decides, and the
score is the share of the text's n-grams that this language accounts for.

Training takes about ``sample_rows`` labelled rows, chosen by a hash of doc_id,
and of a language that has few of these up to ``LANGUAGE_ROWS``: a rare
language gives all its rows, however large the table is.  A language keeps the
n-grams that make up at least ``MIN_SHARE`` of its n-grams, hence at most
1 / MIN_SHARE of them, and of these only the ones not far more common elsewhere.

Defined results: text null, empty or without a letter gives ``und`` and score
0; a text with letters but without n-grams, or without a known one, gives the
commonest language and score 0; without any labelled row all is ``und``;
ties go to the language first by code point; repeated rows are judged alike;
a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codevane.llm import store, wordhash

UNKNOWN = "und"
N = 4
MIN_SHARE = 2e-5
#: An n-gram's share in a language must reach this part of its largest share.
RELATIVE = 0.2
SAMPLE_ROWS = 20_000
#: So many rows of each language are learned from, or all it has.
LANGUAGE_ROWS = 1_000
POSITIONS = 1 << 19
HASHES = 3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def held_out(doc_id: Column) -> Column:
    """True for the rows that training must not see; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _pieces(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, cuts): whole texts together, or overlapping parts of a long one."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + wordhash.BLOCK, "right")) - 1)
        if off[hi] - off[lo] <= wordhash.BLOCK:
            yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        else:
            for a in range(off[lo], max(off[lo] + 1, off[hi] - N + 1), wordhash.BLOCK):
                b = min(off[hi], a + wordhash.BLOCK + N - 1)
                yield lo, hi, data[a:b], np.array([0, b - a])
        lo = hi


def _codes(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a piece as numbers, and which of them count: of one text, and not only breaks."""
    if len(buf) < N:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    f = _FOLD[buf].astype(np.uint32)
    code = (f[:-3] << np.uint32(24)) | (f[1:-2] << np.uint32(16)) | (f[2:-1] << np.uint32(8)) | f[3:]
    ok = code != 0x20202020
    for i in range(1, N):
        b = cuts[1:-1] - i
        ok[b[(b >= 0) & (b < len(ok))]] = False
    return code, ok


def _positions(code: np.ndarray, i: int) -> np.ndarray:
    shift = np.uint64(64 - (POSITIONS.bit_length() - 1))
    return ((code.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[i]) >> shift


@dataclass(frozen=True)
class Model:
    """languages: sorted; table: for each slice of 64 languages and position a bit set; rates: of false positives."""

    languages: tuple[str, ...]
    table: np.ndarray
    rates: np.ndarray
    commonest: int


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, training: Column | None = None) -> Model:
    """Learns from rows with text and lang, by default those whose id is not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (~held_out(F.col("doc_id")) if training is None else training))
    rows = rows.select("text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("bucket"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    n = sum(sizes.values())
    shares = {lang: min(1.0, max(sample_rows / n, LANGUAGE_ROWS / own)) for lang, own in sizes.items()}
    if n > sample_rows:
        limits = docs.sparkSession.createDataFrame([(lang, max(1, int((1 << 20) * share))) for lang, share in shares.items()], "lang string, upto long")
        rows = rows.join(F.broadcast(limits), "lang").where(F.col("bucket") < F.col("upto"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
            code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return [(code, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for batch in batches:
            for lang in batch.column(1).unique().to_pylist():
                texts = batch.column(0).filter(pc.equal(batch.column(1), lang))
                for _, _, buf, cuts in _pieces(*wordhash.buffers(texts)):
                    code, ok = _codes(buf, cuts)
                    own = held.setdefault(lang, [])
                    own.append(np.unique(code[ok], return_counts=True))
                    if len(own) > 16:
                        held[lang] = merged(own)
        for lang, parts in held.items():
            for code, times in merged(parts):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "code", "times"])

    counts = rows.select("text", "lang").mapInArrow(store.frugal(count), "lang string, code long, times long").groupBy("lang", "code").agg(F.sum("times").alias("times"))
    totals = counts.groupBy("lang").agg(F.sum("times").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("times") >= MIN_SHARE * F.col("total"))
    got = kept.select("lang", "code", (F.col("times") / F.col("total")).alias("share"), "total").toPandas()
    languages = tuple(sorted(got["lang"].unique(), key=lambda s: s.encode()))
    slices = max(1, -(-len(languages) // 64))
    table = np.zeros((slices, POSITIONS), np.uint64)
    if not languages:
        return Model((), table, np.zeros(0), 0)
    got = got[got["share"] >= RELATIVE * got.groupby("code")["share"].transform("max")]
    rates = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        code = got["code"][got["lang"] == lang].to_numpy().astype(np.uint32)
        for k in range(HASHES):
            table[i // 64, _positions(code, k)] |= np.uint64(1 << (i % 64))
        rates[i] = np.mean((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) ** HASHES
    weight = got.groupby("lang")["total"].max()
    return Model(languages, table, rates, int(np.argmax([weight[x] / shares[x] for x in languages])))


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def classify(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text."""
    off, data = wordhash.buffers(texts)
    n, k = len(off) - 1, len(model.languages)
    total, hits, letters = np.zeros(n, np.int64), np.zeros((n, max(k, 1)), np.int64), np.zeros(n, bool)
    for lo, hi, buf, cuts in _pieces(off, data):
        def by_text(marks: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(marks, out=sums[1 : len(marks) + 1])
            sums[len(marks) + 1 :] = sums[len(marks)]
            return sums[cuts[1:]] - sums[cuts[:-1]]

        letters[lo:hi] |= by_text(_LETTER[buf]) > 0
        code, ok = _codes(buf, cuts)
        total[lo:hi] += by_text(ok)
        for s in range(len(model.table)):
            mask = model.table[s][_positions(code, 0)]
            for i in range(1, HASHES):
                mask &= model.table[s][_positions(code, i)]
            mask[~ok] = 0
            for j in range(s * 64, min(k, s * 64 + 64)):
                hits[lo:hi, j] += by_text((mask >> np.uint64(j % 64)) & np.uint64(1))
    for i in np.flatnonzero(~letters):
        letters[i] = _has_letter(texts[int(i)].as_py())
    if not k:
        return [UNKNOWN] * n, np.zeros(n)
    true = np.maximum((hits - total[:, None] * model.rates) / (1 - model.rates), 0)
    best = np.argmax(true, axis=1)
    top = true[np.arange(n), best]
    best = np.where(top > 0, best, model.commonest)
    score = np.where(letters, np.minimum(top / np.maximum(total, 1), 1), 0)
    return [model.languages[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = classify(batch.column(at), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(store.frugal(run), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, fit(docs)).drop("text")
