"""Near copies by a grouped prefix join on word n-grams.

Every document is the set of its n-grams.  Documents of equal words are one
class.  In an order of all n-grams, rare ones first, two sets similar enough
share an n-gram of their prefixes.  Classes of equal prefix and size form a
group; only groups are joined by n-grams.  Pairs pass the size filter, the
filter of the places where they meet and a filter on signatures, are expanded
to their members, and are verified on the words themselves.

What is asked for is the components of the links, so pairs of one component
need no second look.  Each list of a prefix n-gram, and each group of two
members or more, is gone through in three turns, and what a turn finds is
verified before the next:

1. Its groups are paired with the one of fewest rarer n-grams, and a group's
   members with its least.
2. Lists whose members are still in several components are expanded to
   members.  A short list gives all pairs that pass the filters; a long one a
   spanning forest of them.
3. Long lists give all pairs that pass and still differ in component.

A signature holds, for each of its bits, whether the set has an odd number of
n-grams there; bits in which two signatures differ bound from below what only
one of the sets has.  So pairs that are not alike hardly ever go further.  A
long list is cut into slices and each pair of slices is a piece of work of its
own: no task holds more than two slices of a list.

n-gram counts for the order are kept in 2**SKETCH_BITS cells, summed over all
documents; n-grams that meet in a cell count together, which can only change
the order and thus the cost.  Candidates come from 64-bit hashes; classes are
told apart by a cryptographic hash of their words, and links are decided by
comparing words.

Defined results: a text with fewer words than an n-gram is one n-gram of all of
them; a text null or without words is empty and linked with nothing; a row
without an id is linked with nothing and has no component; rows that repeat an
id count as one document, linked if one of its texts is; a table without rows
gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codevane.llm import store, wordhash
from codevane.llm.components import components

SKETCH_BITS = 20
#: Bits of an n-gram's hash in prefixes and lists, where a chance meeting only makes a candidate.
TOKEN_BITS = 40
#: Columns of 64 bits that are a signature; with their number the bits are a power of two.
SIGNATURE = [f"g{i}" for i in range(8)]
#: Members of a list that are a slice on average, and up to how many members a list counts as short.
SLICE, SHORT = 2048, 32
#: Pairs of one document that are verified in one task.
FAN = 256


@dataclass(frozen=True)
class Rule:
    """n-grams of ``words`` words; linked if ``den`` * common >= ``num`` * all of both."""

    words: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        """How many of n n-grams, in order, any similar set must meet."""
        return n - -(-self.num * n // self.den) + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted set of n-gram hashes of each text."""
        k = self.words
        for b in wordhash.blocks(texts, lower=True):
            h = wordhash.runs(b.hash, k)
            for x, y in zip(b.at[:-1].tolist(), b.at[1:].tolist(), strict=True):
                if y - x >= k:
                    s = np.sort(h[x : y - k + 1])
                    yield s[np.concatenate([[True], s[1:] != s[:-1]])]
                else:
                    yield wordhash.runs(b.hash[x:y], y - x) if y > x else np.zeros(0, np.uint64)

    def grams(self, words: list[bytes]) -> set[tuple[bytes, ...]]:
        """The set of n-grams of a text's words."""
        if len(words) < self.words:
            return {tuple(words)} if words else set()
        return set(zip(*[words[i:] for i in range(self.words)], strict=False))

    def linked(self, a: set, b: set) -> bool:
        c = len(a & b)
        return c > 0 and self.den * c >= self.num * (len(a) + len(b) - c)


def _words(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or b"").lower().split()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _sketch(docs: DataFrame, rule: Rule) -> np.ndarray:
    width = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        v, held, n = np.zeros(width, np.int64), [], 0
        for batch in batches:
            for s in rule.sets(batch.column(0)):
                held.append(s)
                n += len(s)
                if n > width:
                    v += np.bincount((np.concatenate(held) & np.uint64(width - 1)).astype(np.int64), minlength=width)
                    held, n = [], 0
        if held:
            v += np.bincount((np.concatenate(held) & np.uint64(width - 1)).astype(np.int64), minlength=width)
        return v

    return np.minimum(store.summed(docs.select("text"), count, width), np.iinfo(np.int32).max).astype(np.int32)


def _signed(values: list | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _signature(s: np.ndarray) -> np.ndarray:
    bits = 64 * len(SIGNATURE)
    at = (s >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _prefixes(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, class, prefix) and the signature: size of the set, hash of the words, prefix."""
    held = docs.sparkSession.sparkContext.broadcast(_sketch(docs, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            n, prefix, sig = [], [], []
            texts = batch.column(1).cast(pa.large_binary())
            for s in rule.sets(batch.column(1)):
                n.append(len(s))
                order = np.argsort(counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)], kind="stable")
                prefix.append(s[order[: rule.prefix(len(s))]] >> np.uint64(64 - TOKEN_BITS) if len(s) else s)
                sig.append(_signature(s))
            same = [hashlib.blake2b(b" ".join(_words(t)), digest_size=16).digest() for t in texts]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            marks = np.array(sig, np.int64).reshape(-1, len(SIGNATURE))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(offsets, _signed(flat)), *[pa.array(m) for m in marks.T.copy()]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "class", "prefix", *SIGNATURE])

    return _rows(docs).mapInArrow(store.frugal(run), "doc_id long, n long, class binary, prefix array<long>, " + ", ".join(f"{g} long" for g in SIGNATURE))


def _hubs(shared: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of each list's first group in rarity with the others, by size and place."""
    n, m = F.col("n"), F.col("hub.n")
    sizes = rule.den * F.least(n, m) >= rule.num * F.greatest(n, m)
    reach = F.least(n - F.col("pos"), m - F.col("hub.pos")) >= _need(rule, n, m)
    return shared.where((F.col("id") != F.col("hub.id")) & sizes & reach).select(F.col("hub.id").alias("a"), F.col("id").alias("b"))


def _need(rule: Rule, n: Column, m: Column) -> Column:
    """The least overlap of linked sets of sizes n and m."""
    return F.ceil(F.lit(rule.num) * (n + m) / F.lit(rule.num + rule.den))


def _near(pairs: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs, smaller id first, that the signatures leave possible; an id may have several."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(signed.select(F.col("id").alias(side), F.col("n").alias("n" + side), *[F.col(g).alias(g + side) for g in SIGNATURE]), side)
    apart = sum((F.bit_count(F.col(g + "a").bitwiseXOR(F.col(g + "b"))) for g in SIGNATURE), F.lit(0))
    n, m = F.col("na"), F.col("nb")
    return pairs.where(F.shiftright(n + m - apart, 1) >= _need(rule, n, m)).select("a", "b").distinct()


def _several(lists: DataFrame, comps: DataFrame, least: int) -> DataFrame:
    """Rows (token, id, n, pos) of lists of at least ``least`` members of more than one component, with ``comp`` and the list's ``size``."""
    named = lists.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
    return named.join(mixed.where((F.col("lo") < F.col("hi")) & (F.col("size") >= least)).select("token", "size"), "token")


def _cells(members: DataFrame) -> DataFrame:
    """Members dealt to pairs of slices (x, y) of their list, so that every two of a list meet in one cell, or more for two of one slice."""
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    members = members.withColumn("slices", slices).withColumn("s", F.pmod(F.xxhash64("id"), F.col("slices").cast("long")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.least(k, F.col("s")).alias("x"), F.greatest(k, F.col("s")).alias("y")))
    return members.withColumn("cell", F.explode(cells)).select("token", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "s", "size", "id", "n", "pos", "comp", *SIGNATURE)


def _groups_of(cols: list[np.ndarray], keys: int) -> np.ndarray:
    """The starts of the stretches of rows that are alike in their first ``keys`` columns."""
    fresh = np.ones(len(cols[0]), bool)
    if len(cols[0]):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
    return np.flatnonzero(fresh)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, smaller id first."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) & (lo != hi) if len(lo) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new])], names=["a", "b"])


@dataclass
class _Cell:
    """Columns of some members, and the filters on pairs of places."""

    rule: Rule
    ids: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    sig: np.ndarray

    def near(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) pass all filters."""
        a, b = self.n[i], self.n[j]
        need = self.rule.common(a, b)
        ok = (self.rule.den * np.minimum(a, b) >= self.rule.num * np.maximum(a, b)) & (np.minimum(a - self.pos[i], b - self.pos[j]) >= need)
        k = np.flatnonzero(ok)
        if len(k):
            one = self.sig[i] if np.isscalar(i) else self.sig[i[k]]
            apart = np.bitwise_count(one ^ self.sig[j[k]]).sum(axis=1, dtype=np.int64)
            most = ((a if np.isscalar(i) else a[k]) + b[k] - apart) >> 1
            ok[k] = most >= (need[k] if need.ndim else need)
        return ok


def _candidates(members: DataFrame, rule: Rule, forest: bool) -> DataFrame:
    """Pairs of different components that pass the filters: of long lists all, or with ``forest`` a spanning forest; of short ones all."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(members).repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y", "s", "id")

    def short(c: _Cell, comp: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(start), 4096):
            s, m = start[lo : lo + 4096], size[lo : lo + 4096]
            first = np.concatenate([np.arange(a, a + k) for a, k in zip(s.tolist(), m.tolist())])
            ahead = np.repeat(s + m, m) - first - 1
            i = np.repeat(first, ahead)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
            other = comp[i] != comp[j]
            i, j = i[other], j[other]
            ok = c.near(i, j)
            if ok.any():
                yield _pairs(c.ids[i[ok]], c.ids[j[ok]])

    def long(c: _Cell, comp: np.ndarray, side: np.ndarray, across: bool, a: int, b: int) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray]] = []
        label, held = comp[a:b].copy(), 0
        middle = int(np.searchsorted(side[a:b], side[a], "right")) if across else 0
        for i in range(middle or b - a):
            lo = middle if across else i + 1
            j = np.flatnonzero(label[lo:] != label[i]) + lo
            if len(j):
                j = j[c.near(a + i, a + j)]
            if not len(j):
                continue
            if forest:
                names, at = np.unique(label[j], return_index=True)
                j = j[at]
                label[np.isin(label, names)] = label[i]
            found.append((a + i, a + j))
            held += len(j)
            if held > 1 << 18:
                yield _pairs(np.concatenate([np.full(len(y), c.ids[x]) for x, y in found]), np.concatenate([c.ids[y] for _, y in found]))
                found, held = [], 0
        if found:
            yield _pairs(np.concatenate([np.full(len(y), c.ids[x]) for x, y in found]), np.concatenate([c.ids[y] for _, y in found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole(batches, 3):
            keys, (side, size, ids, n, pos, comp), marks = cols[:3], cols[3:9], cols[9:]
            c = _Cell(rule, ids, n, pos, np.stack(marks, axis=1).view(np.uint64))
            start = _groups_of(cols, 3)
            count = np.diff(np.append(start, len(ids)))
            small = size[start] <= SHORT
            yield from short(c, comp, start[small], count[small])
            for a, k in zip(start[~small].tolist(), count[~small].tolist()):
                yield from long(c, comp, side, bool(keys[1][a] != keys[2][a]), a, a + k)

    return cells.mapInArrow(store.frugal(run), "a long, b long").distinct()


def _whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of a sorted partition, cut so that rows alike in their first ``keys`` columns stay together."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        last = int(_groups_of(cols, keys)[-1])
        fresh = bool(held) and any(c[0] != h[-1] for c, h in zip(cols[:keys], held[-1], strict=False))
        if held and (last or fresh):
            if last:
                held.append([c[:last] for c in cols])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        elif last:
            yield [c[:last] for c in cols]
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _linked(pairs: DataFrame, docs: DataFrame, rule: Rule, twice: bool) -> DataFrame:
    """The pairs that are linked, by their words; with ``twice`` an id may have several texts.

    A pair carries the text of its ``b``; the text of ``a`` goes once to each
    group of FAN pairs.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("fan"))
    pairs = store.written(pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "fan")).select("a", "b", "salt"))
    ids = store.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = store.passing(_rows(docs).where("doc_id is not null"), "doc_id", ids, "id")
    texts = store.written(texts.distinct() if twice else texts)
    ones = pairs.select("a", "salt").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(texts, F.col("b") == F.col("doc_id")).select("a", "salt", "b", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = ones.unionByName(others).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[set] = []
        now = None
        for batch in batches:
            a, b = [], []
            for x, salt, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary()), strict=True):
                if (x, salt) != now:
                    now, own = (x, salt), []
                grams = rule.grams(_words(text))
                if y is None:
                    own.append(grams)
                elif any(rule.linked(o, grams) for o in own):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = store.written(both.mapInArrow(store.frugal(verify), "a long, b long"))
    store.drop(texts, ids, pairs)
    return links


def join(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = store.written(_prefixes(docs, rule))
    known = rows.where("doc_id is not null and n > 0")
    same = ["n", F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit(1), "prefix").alias("p2")]
    classes = store.written(known.groupBy("class").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "prefix", *SIGNATURE)]))
    groups = store.written(classes.select("node", "prefix", *same).groupBy("n", "p1", "p2").agg(F.min("node").alias("id"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("size")))
    members = store.written(classes.select("node", *same).join(groups.where("size > 1").select("n", "p1", "p2", "id"), ["n", "p1", "p2"]).select("id", "node", "n"))
    signed = classes.select(F.col("node").alias("id"), "n", *SIGNATURE)
    # ids that stand in several rows; their classes are one document's
    again = store.written(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("k > 1").select("doc_id", (F.col("lo") < F.col("hi")).alias("differ")))
    twice = not again.isEmpty()
    links = []
    if twice:
        own = known.join(again.where("differ"), "doc_id").select("doc_id", "class").join(classes.select("class", "node"), "class")
        links.append(store.written(own.groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")))

    postings = groups.select("n", "id", "size", F.posexplode("prefix").alias("pos", "token"))
    tokens = store.written(postings.groupBy("token").agg(F.min(F.struct("pos", "n", "id")).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "hub"))
    shared = store.written(store.passing(postings, "token", tokens, "token").join(tokens, "token"))
    tried: list[DataFrame] = []
    comps: DataFrame | None = None

    def turn(pairs: DataFrame) -> None:
        """Verifies pairs that no turn has had yet, and joins components."""
        nonlocal comps
        for had in tried:
            pairs = pairs.join(had, ["a", "b"], "left_anti")
        pairs = store.written(pairs)
        tried.append(pairs)
        if not pairs.isEmpty():
            links.append(_linked(pairs, docs, rule, twice))
        elif comps is not None:
            return
        edges = pairs.where("false")
        for more in links:
            edges = edges.unionByName(more)
        if comps is not None:
            store.drop(comps)
        comps = components(edges)

    turn(_near(_hubs(shared, rule).unionByName(members.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))), signed, rule))
    # the lists: n-grams of two groups or more with all their members, and groups of two members or more
    alone = shared.where("size = 1").select("token", "id", "n", "pos")
    spread = shared.where("size > 1").select("token", "id", "pos").join(members, "id").select("token", F.col("node").alias("id"), "n", "pos")
    inner = members.select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("token"), F.col("node").alias("id"), "n", F.lit(0).alias("pos"))
    lists = alone.unionByName(spread).unionByName(inner)
    for forest, least in ((True, 2), (False, SHORT + 1)):
        few = store.written(_several(lists, comps, least))
        if not few.isEmpty():
            turn(_candidates(few.join(signed.drop("n"), "id"), rule, forest))
        store.drop(few)
    named = store.written(classes.select("class", "node").join(comps, "node", "left").select("class", F.coalesce("component", "node").alias("component_id")))
    own = rows.select("doc_id", "n", "class")
    full = own.where("doc_id is not null and n > 0").join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    store.drop(classes, groups, members, again, tokens, shared, comps, *tried, *links)
    return full.unionByName(own.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def digest(docs: DataFrame) -> DataFrame:
    return join(docs, Rule(3, 90, 100))


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
  from d
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as x, doc_id as y from d union select r.x, e.b from r join e on r.y = e.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id
from d left join n on n.doc_id = d.doc_id join (select x, min(y) as component_id from r group by x) m on m.x = d.doc_id
"""
