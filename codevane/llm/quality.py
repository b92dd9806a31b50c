"""Quality rules: a likelihood ratio of hashed byte n-grams, and plain base rules.

Two multinomials over hashed n-grams are fitted: one to trusted documents, one
to the whole corpus.  A document's score is the mean log ratio of its n-grams,
so its length does not matter; every document at or above ``threshold`` that
passes the base rules is kept.  Ratios are fixed-point integers, so sums and
verdicts do not depend on how rows are batched.

Corpus counts cover every document.  Trusted counts use at most
``trusted_rows`` rows labelled good and not toxic, taken in hash order.

Defined results: a null text has no words and fails the base rules; repeated
rows count, and are judged, as often as they stand; without any trusted row
all ratios are 0 and only the base rules decide; a table without rows gives
none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevane.llm import store, wordhash

BUCKETS = 1 << 16
N = 3
#: Added to every count, as a share of the mean count of a bucket.
SMOOTH = 0.01
SCALE = 10_000
#: Halfway between clean text, near 0, and text whose n-grams the trusted rows lack.
THRESHOLD = -0.5
TRUSTED_ROWS = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(buf: np.ndarray) -> np.ndarray:
    """The bucket of each run of N bytes."""
    if len(buf) < N:
        return np.zeros(0, np.int64)
    b = buf.astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _inside(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one n-gram of each document of a block."""
    return cuts[:-1], np.maximum(cuts[1:] - (N - 1), cuts[:-1])


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """The log ratio of each bucket, times SCALE, as int64."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    ids = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).toArrow().column(0).to_numpy()
    trusted = np.sort(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        v = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.isin(ids, trusted) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            off, data = wordhash.buffers(batch.column(1))
            lo = 0
            while lo < len(off) - 1:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + wordhash.BLOCK, "right")) - 1)
                for good in (False, True):
                    own = known[lo:hi] if good else ~known[lo:hi]
                    if not own.any():
                        continue
                    a, b = _inside(off[lo : hi + 1] - off[lo])
                    step = np.zeros(off[hi] - off[lo] + 1, np.int8)
                    np.add.at(step, a[own], 1)
                    np.add.at(step, b[own], -1)
                    g = grams(data[off[lo] : off[hi]])
                    n = np.bincount(g[np.cumsum(step[: len(g)], dtype=np.int8) > 0], minlength=BUCKETS)
                    v[:BUCKETS] += n
                    if good:
                        v[BUCKETS:] += n
                lo = hi
        return v

    v = store.summed(docs.select("doc_id", "text"), count, 2 * BUCKETS).astype(float)
    raw, target = v[:BUCKETS], v[BUCKETS:]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    # a count's share, drawn to the corpus share where the trusted rows are few
    prior = (raw + SMOOTH * raw.sum() / BUCKETS) / (raw.sum() * (1 + SMOOTH))
    p = (target + SMOOTH * target.sum() * prior) / (target.sum() * (1 + SMOOTH))
    return np.round(SCALE * np.log(p / prior)).astype(np.int64)


def _per_document(marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[np.minimum(b, len(marks))] - sums[np.minimum(a, len(marks))]


def _repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: does its document hold it again; is an equal one before it (in the order given)."""
    both = wordhash.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure(texts: pa.Array, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, grams and ratio sum of each text."""
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "sum")}
    off, _ = wordhash.buffers(texts)
    for b in wordhash.blocks(texts, spans=True):
        cuts = off[b.lo : b.hi + 1] - off[b.lo]
        docs = np.arange(b.hi - b.lo)
        found["n_words"].append(np.diff(b.at))
        space = wordhash._SPACE[b.buf]
        found["word_chars"].append(_per_document(((b.buf & 0xC0) != 0x80) & ~space, cuts[:-1], cuts[1:]))
        found["n_symbols"].append(_per_document(_SYMBOL[b.buf], cuts[:-1], cuts[1:]))
        # lines end at \n or where their text ends
        brk = np.flatnonzero(b.buf == 10)
        starts = np.union1d(brk + 1, cuts[:-1])
        starts = starts[starts < len(b.buf)].astype(np.int64)
        doc = np.searchsorted(cuts, starts, "right") - 1
        ends = np.minimum(np.append(brk, len(b.buf))[np.searchsorted(brk, starts)], cuts[doc + 1])
        first = np.searchsorted(b.start, starts)
        worded = (first < len(b.start)) & (b.start[np.minimum(first, max(0, len(b.start) - 1))] < ends) if len(b.start) else np.zeros(len(starts), bool)
        starts, ends, doc = starts[worded], ends[worded], doc[worded]
        _, later = _repeated(doc, _line_hash(b.buf, starts, ends))
        found["n_dup_lines"].append(np.bincount(doc[later], minlength=len(docs)))
        h = wordhash.runs(b.hash, 3)
        ok = np.flatnonzero(wordhash.same_document(b.at, 3, len(b.hash)))
        twice, _ = _repeated(np.searchsorted(b.at, ok, "right") - 1, h[ok])
        covered = np.zeros(len(b.hash), bool)
        for i in range(3):
            covered[ok[twice] + i] = True
        found["n_repeat_words"].append(_per_document(covered, b.at[:-1], b.at[1:]))
        lo, hi = _inside(cuts)
        found["n_grams"].append(hi - lo)
        found["sum"].append(_per_document(ratio[grams(b.buf)], lo, hi))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in found.items()}


def _line_hash(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """Hashes of lines, in parts of at most a few blocks."""
    if len(buf) <= 2 * wordhash.BLOCK or not len(st):
        return wordhash._hash(buf, st, en)
    parts, a = [], 0
    while a < len(st):
        b = max(a + 1, int(np.searchsorted(en, st[a] + wordhash.BLOCK, "right")))
        parts.append(wordhash._hash(buf[st[a] : en[b - 1]], st[a:b] - st[a], en[a:b] - st[a]))
        a = b
    return np.concatenate(parts)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The measures, the base rules' outcome, the verdict and the score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1), held.value)
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            mean = m["sum"] / np.maximum(m["n_grams"], 1) / SCALE
            cols = [batch.column(0), *[pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(~failed & (mean >= threshold)), pa.array(mean)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCHEMA)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))


#: The same rules in SQL, for label tables of at most TRUSTED_ROWS good rows and ids that do not repeat.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from d)),
rep as (select doc_id, g from win group by all having count(*) > 1),
cov as (select doc_id, count(distinct i) as n from (select doc_id, unnest(range(p, p + 3)) as i from win semi join rep using (doc_id, g)) group by doc_id),
m as (
  select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from d
), h as (select doc_id, hex(encode(t)) as h from d),
gram as (
  select doc_id, ((cast('0x' || substr(h, cast(2 * i + 1 as bigint), 6) as bigint) * 2654435761) % 4294967296) >> 16 as g
  from (select doc_id, h, unnest(range(0, length(h) // 2 - 2)) as i from h)
), good as (select distinct doc_id from labels where quality = 1 and coalesce(toxic, 0) = 0),
cnt as (select g, cast(count(*) as double) as raw, cast(count(good.doc_id) as double) as own from gram left join good on good.doc_id = gram.doc_id group by g),
share as (select g, own, (raw + 0.01 * sum(raw) over () / 65536) / (sum(raw) over () * 1.01::double) as prior, sum(own) over () as total from cnt),
ratio as (select g, cast(round(10000 * ln((own + 0.01 * total * prior) / (total * 1.01::double) / prior)) as bigint) as r from share),
s as (select doc_id, cast(sum(r) as double) / count(*) / 10000 as score from gram join ratio using (g) group by doc_id),
f as (
  select m.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, coalesce(s.score, 0) as score
  from m left join cov using (doc_id) left join s using (doc_id)
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and score >= -0.5 as kept, score
from f
"""
