"""Removal of long repeated word sequences, found by recompression.

A text's words are shortened by rounds.  A round gives a name to every short
run of equal symbols, or to every pair of neighbours whose coins fall left and
right; a name is a hash of what it stands for, so all tasks name alike, and
equal word sequences get equal symbols everywhere but near their ends.  Only
symbols up to a round's cap take part, so an end can upset at most ``cap``
words in a round, and LOSS words in all.

Every window of WINDOW words picks the symbol of least hash among those that
lie wholly in its undisturbed middle: its anchor.  Equal windows pick equal
anchors, and neighbours mostly share theirs, so there is about one anchor in 17
words.  Three rounds over all tasks then name what stands around an anchor,
each longer than the last, by grouping; names of one document only are done
with:

1. The words that all windows of an anchor have.
2. All words of its windows, from the first window to the last.  Anchors of a
   name of round 1 that agree in this are settled: all their windows are equal.
3. Each window, where they do not agree, as at the ends of repeats.

What is found in a document with a smaller id is removed.  Rounds 2 and 3 name
by a cryptographic hash of the words themselves, of 128 bits, so that what is
removed is decided by words at any number of windows.  Round 1 only says what
to look at.  Every step is a join or a sum over groups, which are only ever
reduced to a minimum and never listed.

Defined results: a null text has no words; rows without an id keep all words
and remove none elsewhere; rows that repeat an id do not remove each other's
words; texts shorter than a window stay as they are; a table without rows gives
none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevane.llm import store, wordhash

WINDOW = 50
#: The rounds: runs or pairs, and the most words in a symbol that takes part (for runs, in the run).
ROUNDS = (("run", 2), ("pair", 1), ("pair", 1), ("pair", 2), ("pair", 2))
LOSS = sum(cap for _, cap in ROUNDS)
LONGEST = 4
_K1, _K2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the name of each symbol after all rounds; no symbol crosses texts."""
    name, start, size = words, np.arange(len(words)), np.ones(len(words), np.int64)
    for level, (kind, cap) in enumerate(ROUNDS):
        if len(name) < 2:
            break
        near = doc[start[1:]] == doc[start[:-1]]
        if kind == "run":
            fresh = np.concatenate([[True], ~(near & (name[1:] == name[:-1]))])
            first = np.flatnonzero(fresh)
            count = np.diff(np.append(first, len(name)))
            short = (count > 1) & (count * size[first] <= cap)
            keep = np.ones(len(name), bool)
            inner = np.repeat(short, count) & ~fresh
            keep[inner] = False
            new = name.copy()
            new[first[short]] = wordhash.mix(name[first[short]] * _K1 + count[short].astype(np.uint64) + np.uint64(level))
            grown = size.copy()
            grown[first[short]] *= count[short]
            name, start, size = new[keep], start[keep], grown[keep]
        else:
            coin = (wordhash.mix(name + np.uint64(0x9E37) * np.uint64(level + 1)) >> np.uint64(17)) & np.uint64(1) == 1
            able = size <= cap
            left = np.flatnonzero(near & able[:-1] & able[1:] & ~coin[:-1] & coin[1:])
            new, grown = name.copy(), size.copy()
            new[left] = wordhash.mix(name[left] * _K1 + name[left + 1] * _K2 + np.uint64(level))
            grown[left] += size[left + 1]
            keep = np.ones(len(name), bool)
            keep[left + 1] = False
            name, start, size = new[keep], start[keep], grown[keep]
    return start, name


def _least(rank: np.ndarray, width: int) -> np.ndarray:
    """For each place, the place of the first least value among the next ``width``."""
    at, best, have = np.arange(len(rank)), rank, 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        later = best[step:] < best[:m]
        best, at = np.where(later, best[step:], best[:m]), np.where(later, at[step:], at[:m])
        have += step
    return at


class Hasher:
    """Hashes of word sequences of a block: hash of words a to b-1 in constant time."""

    def __init__(self, words: np.ndarray):
        high, low, self.inverse = wordhash._tables(len(words) + 1)
        n = len(words)
        value = wordhash.product(words >> np.uint64(3), (high[:n] << np.uint64(30)) | low[:n])
        self.high, self.low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(value >> np.uint64(30), out=self.high[1:])
        np.cumsum(value & np.uint64((1 << 30) - 1), out=self.low[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        value = wordhash.joined(self.high[b] - self.high[a], self.low[b] - self.low[a])
        return wordhash.mix(wordhash.product(value, self.inverse[a]) + (b - a).astype(np.uint64) * _K2)


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor of a block: its text, key, place, first window and number of windows.

    ``at`` holds the first word of each text and the end.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none.astype(np.uint64), none, none, none
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start, name = symbols(words, doc)
    rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    rank[start] = wordhash.mix(name ^ _K2) >> np.uint64(1)
    spot = _least(rank[LOSS:], WINDOW - 2 * LOSS - LONGEST + 1) + LOSS
    p = np.arange(n - WINDOW + 1)
    inside = doc[p] == doc[p + WINDOW - 1]
    spot = spot[: len(p)]
    fresh = np.concatenate([[True], (spot[1:] != spot[:-1]) | (doc[p[1:]] != doc[p[:-1]])]) | ~inside
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(p)))
    good = inside[first]
    first, count = first[good], count[good]
    s = spot[first]
    h = Hasher(words)
    return doc[first], h.of(s - LOSS, s + LONGEST + LOSS), s, first, count


class Words:
    """The words of a block, each parted from the next by one blank, and hashes of stretches of them."""

    def __init__(self, block: wordhash.Block):
        kept = ~wordhash._SPACE[block.buf]
        after = block.end[block.end < len(kept)]
        kept[after] = True
        buf = np.where(wordhash._SPACE[block.buf], np.uint8(32), block.buf)
        at = np.concatenate([[0], np.cumsum(kept)])
        self.bytes = memoryview(buf[kept].tobytes())
        self.start, self.end = at[block.start], at[block.end]

    def hashes(self, a: np.ndarray, b: np.ndarray, more: np.ndarray | None = None) -> list[bytes]:
        """128-bit hashes of words a to b-1, with a number each."""
        new, view = hashlib.blake2b, self.bytes
        lo, hi = self.start[a].tolist(), self.end[b - 1].tolist()
        marks = [b""] * len(lo) if more is None else [int(x).to_bytes(4, "little") for x in more]
        return [new(view[x:y], digest_size=16, salt=m).digest() for x, y, m in zip(lo, hi, marks, strict=True)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, text) of rows with an id; ``row`` is the hash of the text, which tells rows of one id apart."""
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def named(rows: DataFrame) -> DataFrame:
    """Every anchor: (key, doc_id, row, first, n, content), the name of round 1, its windows, and the name of round 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in wordhash.blocks(batch.column(2), spans=True):
                d, key, s, first, count = anchors(b.hash, b.at)
                content = Words(b).hashes(first, first + count + WINDOW - 1, s - first)
                cols = [_signed(key), pa.array(ids[b.lo + d]), pa.array(hashes[b.lo + d]), pa.array((first - b.at[d]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "row", "first", "n", "content"])

    return rows.mapInArrow(store.frugal(run), "key long, doc_id long, row long, first int, n int, content binary")


def windows(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """Every window that ``spots`` (doc_id, row, spots of first window and number) tell of: (what, doc_id, row, at), the name of round 3."""
    some = store.passing(rows, "doc_id", spots, "doc_id").dropDuplicates(["doc_id", "row"]).join(spots, ["doc_id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for b in wordhash.blocks(batch.column(2), spans=True):
                words = Words(b)
                for i in range(b.lo, b.hi):
                    first, n = (lists[i].values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    a = at + b.at[i - b.lo]
                    cols = [pa.array(words.hashes(a, a + WINDOW), pa.binary()), pa.array(np.full(len(at), ids[i])), pa.array(np.full(len(at), hashes[i])), pa.array(at.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["what", "doc_id", "row", "at"])

    return some.select("doc_id", "row", "text", "spots").mapInArrow(store.frugal(run), "what binary, doc_id long, row long, at int")


def removable(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of words to remove: (doc_id, row, spots), spots being (first word, number of words)."""
    rows = _rows(docs, doc_id, text)
    every = store.written(named(rows))
    sums = every.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    shared = store.written(sums.where("least < last").select("key", "least", (F.col("lo") == F.col("hi")).alias("alike")))
    some = store.written(every.join(shared, "key").select("doc_id", "row", "first", "n", "least", "alike"))
    whole = some.where(F.col("alike") & (F.col("doc_id") > F.col("least"))).select("doc_id", "row", F.col("first").alias("at"), (F.col("n") + (WINDOW - 1)).alias("n"))
    spots = store.written(some.where("not alike").groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("spots")))
    found = store.written(windows(rows, spots))
    # a table of its own, so that the join below is one of two plain shuffles, whose large keys Spark splits
    firsts = store.written(found.groupBy("what").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("what", "first"))
    again = found.join(firsts, "what").where(F.col("doc_id") > F.col("first")).select("doc_id", "row", "at", F.lit(WINDOW).alias("n"))
    out = store.written(whole.unionByName(again).groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "n")).alias("spots")))
    store.drop(every, shared, some, spots, found, firsts)
    return out


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document, joined by one space."""
    spots = removable(docs).select(F.col("doc_id").alias("__sub_id"), F.col("row").alias("__sub_row"), "spots")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__sub_text"), "text")
    both = own.join(spots, (F.col("doc_id") == F.col("__sub_id")) & (F.col("__sub_text") == F.col("__sub_row")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            texts = batch.column(1).cast(pa.large_binary())
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                n.append(len(words))
                spot = batch.column(2)[i]
                if spot.is_valid and len(spot):
                    at, width = (spot.values.field(k).to_numpy() for k in (0, 1))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + width, -1)
                    stay = np.cumsum(step[:-1]) == 0
                    removed.append(len(words) - int(stay.sum()))
                    words = [words[k] for k in np.flatnonzero(stay)]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.select("doc_id", "text", "spots").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return cleaned(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
v as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from d)),
f as (select k, min(doc_id) as first from v group by k),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as i from v join f using (k) where first < doc_id),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from each anti join gone using (doc_id, i) group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""
