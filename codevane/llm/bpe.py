"""Byte-pair encoding with a minimal acyclic transducer for frequent words.

The corpus's frequent words are compiled, with the ids they encode to, into an
acyclic automaton whose suffixes are shared.  Each arc adds a number; the sum
along a word is its rank, which selects its ids.  The automaton is one block of
bytes of bounded size: executors get it once, write it to an unlinked file and
map it into memory.  Words it lacks are merged exactly, pair by pair in the
vocabulary's order; those of a block take each step together.

Text is normalised and split as the vocabulary file says: special tokens
first, then NFC and lower case, then the pattern's pieces.  A piece never holds
ASCII white space, so texts are cut there first and each distinct chunk of a
batch is worked on once.

Defined results: a null text is encoded as an empty one (no ids); texts are
encoded whole, whatever their length; repeated rows give repeated results; a
table without rows gives none; columns not named pass through ``encode``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import normalizers

from codevane.llm import store, wordhash

#: Words compiled into the automaton: the most frequent chunks of the corpus.
LEXICON_WORDS = 1 << 16
#: Counts below this are a level each; above, 32 levels a doubling.
EVEN = 1024
#: A longer chunk is never compiled.
LEXICON_BYTES = 64
#: Distinct chunks and pieces a worker remembers between batches, and the bytes of each kind.
MEMORY, MEMORY_BYTES = 1 << 18, 1 << 25


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [out[b] if b in out else chr(next(spare)) for b in range(256)]


#: A merge's value is its rank and its product in one number; its key is the pair of ids.
WIDTH = 20
NEVER = 1 << 60
#: Bytes of the pieces that are merged together: a piece joins others of at most so many; longer ones are merged alone.
TOGETHER = (4, 8, 12, 16, 24, 32, 63)
#: There a pair is one number, its rank and under it its place; this is more than any.
PLACE, NO_PAIR = 6, 1 << 30
#: Unseen chunks that are split at once, and bytes of pieces, padded, that are merged at once.
TURN, CELLS = 1 << 16, 1 << 18
#: After plain letters these are a piece of their own.
STOPS = (b".", b",", b";", b":", b"!", b"?")


@dataclass
class Vocabulary:
    """A vocabulary file of the word-end kind: merges of ids, and the way from text to pieces."""

    merges: dict[int, int]
    inner: list[int]
    last: list[int]
    specials: dict[str, int]
    pieces: regex.Pattern
    tokens: list[str]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["unk_token"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a vocabulary of the word-end kind")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        tokens = [""] * (1 + max([*ids.values(), *specials.values()]))
        for t, i in chain(ids.items(), specials.items()):
            tokens[i] = t
        merges = {ids[x] << WIDTH | ids[y]: rank << WIDTH | ids[x + y] for rank, (x, y) in enumerate(model["merges"])}
        letters = byte_alphabet()
        return cls(merges, [ids[c] for c in letters], [ids[c + end] for c in letters], specials, regex.compile(pattern, regex.V0), tokens)

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece: the leftmost pair of lowest rank is joined until none is left."""
        raw = piece.encode("utf-8")
        if not raw:
            return []
        inner, get = self.inner, self.merges.get
        parts = [inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if len(parts) > 400:
            return self._merge_long(parts)
        pairs = [get(a << WIDTH | b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            parts[i] = best & ((1 << WIDTH) - 1)
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] << WIDTH | parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = get(parts[i] << WIDTH | parts[i + 1], NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """As ``merge``, with a heap of pairs, for pieces of any length."""
        n, get = len(parts), self.merges.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(x, i) for i in range(n - 1) if (x := get(parts[i] << WIDTH | parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            x, i = heapq.heappop(heap)
            j = -1 if gone[i] else right[i]
            if j < 0 or get(parts[i] << WIDTH | parts[j]) != x:
                continue
            parts[i] = x & ((1 << WIDTH) - 1)
            gone[j] = 1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (x := get(parts[a] << WIDTH | parts[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    @cached_property
    def _tables(self) -> tuple[np.ndarray, ...]:
        """Pairs in order, the rank of each, the product of each rank; ids of bytes within and at the end of a piece."""
        if len(self.merges) >= NO_PAIR >> PLACE:
            raise ValueError("too many merges")
        pairs, values = (np.fromiter(x, np.int64, len(self.merges)) for x in (self.merges.keys(), self.merges.values()))
        order, made = np.argsort(pairs), np.zeros(int((values >> WIDTH).max(initial=-1)) + 1, np.int32)
        made[values >> WIDTH] = values & ((1 << WIDTH) - 1)
        # a last pair that none can be, so that every search ends at one
        pairs, ranks = np.append(pairs[order], NEVER), np.append(values[order] >> WIDTH, 0).astype(np.int32)
        return pairs, ranks, made, np.array(self.inner, np.int32), np.array(self.last, np.int32)

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, shifted for its place, or NO_PAIR; a negative id has no pair."""
        pairs, ranks, *_ = self._tables
        asked = left.astype(np.int64) << WIDTH | right
        i = np.searchsorted(pairs, asked)
        return np.where(pairs[i] == asked, ranks[i] << PLACE, np.int32(NO_PAIR))

    @cached_property
    def _starts(self) -> np.ndarray:
        """The keys of all pairs of bytes: first those within a piece, then those at its end."""
        *_, inner, last = self._tables
        return np.concatenate([self._keys(np.repeat(inner, 256), np.tile(x, 256)) for x in (inner, last)])

    def merge_all(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge`` for many pieces: the ids one after another, and where each piece's start and the last one's end."""
        raw = [b"" if isinstance(p, int) else p.encode("utf-8") for p in pieces]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n
        size, done, low = np.zeros(len(raw), np.int64), [], 0
        for high in TOGETHER:
            alike = np.flatnonzero((n > low) & (n <= high))
            for which in np.split(alike, range(CELLS // high, len(alike), CELLS // high)) if len(alike) else ():
                ids, size[which] = self._merge_block(buf, at[which], n[which], high)
                done.append((which, ids))
            low = high
        for i in [*np.flatnonzero(n > low).tolist(), *(i for i, p in enumerate(pieces) if isinstance(p, int))]:
            p = pieces[i]
            ids = np.array([p] if isinstance(p, int) else self.merge(p), np.int32)
            size[i] = len(ids)
            done.append((np.array([i]), ids))
        first = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(int(first[-1]), np.int32)
        for which, ids in done:
            out[spans(first[which], size[which])] = ids
        return out, first

    def _merge_block(self, buf: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of at most ``width`` bytes, and how many each has: in every round each piece joins one pair.

        A piece is a column, its bytes stand in rows 1 to n.  Rows 0 and n + 1
        are no parts (-1); a part that went into the one before it is -1 too.
        """
        *_, made, inner, last = self._tables
        m = len(n)
        row = np.arange(width + 2)[:, None]
        byte = buf[np.clip(at + row - 1, 0, len(buf) - 1)].astype(np.int32)
        parts = np.where((row >= 1) & (row < n), inner[byte], np.int32(-1))
        parts[n, np.arange(m)] = last[byte[n, np.arange(m)]]
        keys = np.full((width + 2, m), NO_PAIR, np.int32)
        pair = (byte[1:-1] << 8 | byte[2:]) + (row[1:-1] == n - 1) * np.int32(1 << 16)
        keys[1:-1] = np.where(row[1:-1] < n, self._starts[pair] | row[1:-1], NO_PAIR)
        left, right = (np.broadcast_to((row + x).astype(np.int8), parts.shape).copy().ravel() for x in (-1, 1))
        parts = parts.ravel()
        live = np.arange(m)
        while True:
            best = keys.min(axis=0)
            on = best < NO_PAIR
            if not on.all():
                live, keys, best = live[on], keys.compress(on, axis=1), best[on]
            if not len(live):
                break
            i = (best & ((1 << PLACE) - 1)).astype(np.int64)
            joined = made[best >> PLACE]
            here = i * m + live
            j = right[here].astype(np.int64)
            gone = j * m + live
            after, before = right[gone].astype(np.int64), left[here].astype(np.int64)
            parts[here], parts[gone] = joined, -1
            right[here], left[after * m + live] = after, i
            flat, column = keys.reshape(-1), np.arange(len(live))
            flat[j * len(live) + column] = NO_PAIR
            flat[i * len(live) + column] = self._keys(joined, parts[after * m + live]) | i
            flat[before * len(live) + column] = self._keys(parts[before * m + live], joined) | before
        parts = parts.reshape(-1, m).T
        kept = parts >= 0
        return parts[kept], kept.sum(axis=1)

    @cached_property
    def _lines(self) -> regex.Pattern:
        return regex.compile(f"{self.pieces.pattern}|\n", regex.V0)

    def split_all(self, chunks: list[bytes]) -> tuple[list[str | int], list[int]]:
        """As ``split`` for many chunks, in an order of its own that is given too; a line feed ends each chunk.

        Chunks and pieces hold no line feed and nothing composes with one, so
        chunks are split as the lines of one text.
        """
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, c in enumerate(chunks):
            kinds[2 if b"<|" in c else 0 if c.isascii() else 1].append(i)
        out: list[str | int] = []
        for normal, which in zip((str.lower, NORMAL.normalize_str), kinds):
            text = b"".join(chunks[i] + b"\n" for i in which).decode("utf-8", "replace")
            out.extend(self._lines.findall(normal(text)))
        for i in kinds[2]:
            out.extend((*self.split(chunks[i]), "\n"))
        return out, list(chain.from_iterable(kinds))

    def split(self, chunk: bytes) -> list[str | int]:
        """The pieces of a chunk without ASCII white space, in order; a special token is its id."""
        if chunk.isalpha():
            return [chunk.lower().decode()]
        if chunk[-1:] in STOPS and chunk[:-1].isalpha():
            return [chunk[:-1].lower().decode(), chr(chunk[-1])]
        text = chunk.decode("utf-8", "replace")
        spots: list[str | int] = [text]
        if "<|" in text:
            marks = "|".join(map(regex.escape, self.specials))
            spots = [self.specials.get(x, x) for x in regex.split(f"({marks})", text) if x]
        out: list[str | int] = []
        for s in spots:
            if isinstance(s, int):
                out.append(s)
            else:
                s = s.lower() if s.isascii() else NORMAL.normalize_str(s)
                out.extend(self.pieces.findall(s))
        return out


NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start to start + n - 1 of each span, one span after another."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Transducer:
    """A minimal acyclic automaton over bytes; the numbers on a word's arcs add up to its rank.

    ``image`` is the whole machine: a header, sorted arcs (state and byte in one
    key), their targets and numbers, final states, and the ids by rank.
    """

    def __init__(self, image: memoryview | bytes):
        head = np.frombuffer(image, np.int64, 5)
        at = 40
        parts = []
        for n, kind in zip(head, (np.int64, np.int32, np.int32, np.uint8, np.int32), strict=True):
            parts.append(np.frombuffer(image, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.targets, self.adds, self.final, rest = parts
        self.offsets, self.ids = (rest[1 : int(rest[0]) + 1], rest[int(rest[0]) + 1 :]) if len(rest) else (rest, rest)

    @staticmethod
    def build(lexicon: dict[bytes, list[int]]) -> bytes:
        """The image for words and their ids; equal suffixes become one state."""
        words = sorted(lexicon)
        register: dict[tuple, int] = {}
        states: list[tuple] = []

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        # the path of the last word; a node is [final, [(byte, state), ...]], its last child still open
        path: list[list] = [[False, []]]
        last = b""
        for w in words:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            for i in range(len(last), same, -1):
                path[i - 1][1].append((last[i - 1], close(path.pop())))
            path.extend([False, []] for _ in w[same:])
            path[-1][0] = True
            last = w
        for i in range(len(last), 0, -1):
            path[i - 1][1].append((last[i - 1], close(path.pop())))
        root = close(path[0])
        # words below each state; children are registered before their parents
        below = np.zeros(len(states), np.int64)
        arcs = []
        for s, (final, out) in enumerate(states):
            n = int(final)
            for byte, to in out:
                arcs.append((s * 256 + byte, to, n))
                n += int(below[to])
            below[s] = n
        arcs.sort()
        keys, targets, adds = (np.array([a[i] for a in arcs], t) for i, t in enumerate((np.int64, np.int32, np.int32)))
        final = np.array([s[0] for s in states] + [root & 255, root >> 8 & 255, root >> 16 & 255, root >> 24], np.uint8)
        ids = [lexicon[w] for w in words]
        offsets = np.cumsum([0, *map(len, ids)])
        rest = np.concatenate([[len(offsets)], offsets, np.array(list(chain.from_iterable(ids)), np.int64)]).astype(np.int32)
        parts = [keys, targets, adds, final, rest]
        out = np.array([len(p) for p in parts], np.int64).tobytes()
        for p in parts:
            raw = p.tobytes()
            out += raw + b"\0" * (-len(raw) % 8)
        return out

    @property
    def root(self) -> int:
        return int.from_bytes(self.final[-4:].tobytes(), "little")

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for one the lexicon lacks: all words take each step together."""
        n = np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero((n > 0) & (n <= LEXICON_BYTES))
        rank[n > LEXICON_BYTES] = -1
        step = 0
        while len(alive) and len(self.keys):
            key = state[alive] * 256 + buf[at[alive] + step]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            rank[alive[~ok]] = -1
            alive, i = alive[ok], i[ok]
            state[alive] = self.targets[i]
            rank[alive] += self.adds[i]
            step += 1
            alive = alive[n[alive] > step]
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        return np.where((rank >= 0) & (self.final[state] == 1), rank, -1)


def mapped(image: bytes) -> Transducer:
    """The machine over a memory-mapped file that has no name any more."""
    f = tempfile.TemporaryFile()
    f.write(image)
    f.flush()
    return Transducer(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))


def folded(chunk: bytes) -> bytes:
    """The form a chunk has in the lexicon; only plain letters are lowered, since others must be composed first."""
    return chunk.lower() if chunk.isascii() and b"<|" not in chunk else chunk


def frequent(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[bytes]:
    """The corpus's most frequent chunks in folded form, at most ``words``, without those that may hold special tokens.

    Counted over every text.  Chunks go in or stay out by levels of about equal
    counts, so nothing is sorted, and no task or driver holds more than those
    that go in.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = [(folded(w), n) for w, n in seen.items() if len(w) <= LEXICON_BYTES and b"<|" not in w]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            off, data = wordhash.buffers(batch.column(0))
            for i in range(0, len(off) - 1, 64):
                part = data[off[i] : off[min(i + 64, len(off) - 1)]]
                # a text's last and the next one's first word must not meet
                if len(part) and not _broken(data, off[i : i + 65]):
                    for a, b in zip(off[i : i + 64], off[i + 1 : i + 65]):
                        seen.update(data[a:b].tobytes().split())
                else:
                    seen.update(part.tobytes().split())
                if len(seen) > MEMORY:
                    yield out()
                    seen.clear()
        yield out()

    counts = store.written(docs.select(text).mapInArrow(store.frugal(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    # how many chunks are about as frequent, from frequent to rare: a few thousand numbers at most
    level = F.when(F.col("n") < EVEN, F.col("n")).otherwise(EVEN + F.floor(F.log2(F.col("n") / EVEN) * 32)).cast("long")
    sizes = counts.groupBy(level.alias("level")).count().collect()
    total, least = 0, None
    for r in sorted(sizes, reverse=True):
        total += r["count"]
        if total > words:
            break
        least = r["level"]
    got = [] if least is None else counts.where(level >= least).select("word").toArrow().column(0).to_pylist()
    store.drop(counts)
    return [bytes(w) for w in got]


def _broken(data: np.ndarray, off: np.ndarray) -> bool:
    """True if white space stands at every place where two texts meet."""
    at = off[1:-1]
    at = at[(at > 0) & (at < len(data))]
    return bool(np.all(wordhash._SPACE[data[at]] | wordhash._SPACE[data[at - 1]]))


def compile_lexicon(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The transducer of chunks with the ids their pieces merge to."""
    memo: dict[str, list[int]] = {}

    def ids(piece: str | int) -> list[int]:
        if isinstance(piece, int):
            return [piece]
        if piece not in memo:
            memo[piece] = vocabulary.merge(piece)
        return memo[piece]

    return Transducer.build({w: list(chain.from_iterable(map(ids, vocabulary.split(w)))) for w in words})


class Memory:
    """Numbers keys as they come; the ids of key i are ``flat[first[i]:first[i + 1]]``."""

    def __init__(self):
        self.number: defaultdict = defaultdict(count().__next__)
        self.flat, self.first, self.bytes = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def unlearned(self) -> list:
        """The keys that have a number and no ids yet, in order."""
        return list(islice(reversed(self.number), len(self.number) + 1 - len(self.first)))[::-1]

    def learn(self, ids: np.ndarray, first: np.ndarray, size: int) -> None:
        """Gives the unlearned keys their ids; ``size`` is the bytes of these keys."""
        self.first = np.concatenate([self.first, len(self.flat) + first[1:]])
        self.flat = np.concatenate([self.flat, ids])
        self.bytes += size

    def full(self) -> bool:
        return len(self.number) > MEMORY or self.bytes > MEMORY_BYTES

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        start = self.first[numbers]
        return self.flat[spans(start, self.first[numbers + 1] - start)]


class Encoder:
    """Encodes batches of texts; made once in each worker."""

    def __init__(self, image: bytes, vocabulary: Vocabulary):
        self.machine, self.vocabulary = mapped(image), vocabulary
        self.known, self.pieces = Memory(), self._ends()

    @staticmethod
    def _ends() -> Memory:
        """A memory of pieces whose number 0 is the end of a chunk, which has no ids."""
        out = Memory()
        out.numbers(["\n"])
        out.learn(np.zeros(0, np.int32), np.zeros(2, np.int64), 1)
        return out

    def _unseen(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of chunks the machine lacks, and for each chunk where its ids start and end."""
        if self.pieces.full():
            self.pieces = self._ends()
        pieces, order = self.vocabulary.split_all(chunks)
        numbers = self.pieces.numbers(pieces)
        new = self.pieces.unlearned()
        self.pieces.learn(*self.vocabulary.merge_all(new), sum(len(p) for p in new if isinstance(p, str)))
        upto = np.cumsum(np.diff(self.pieces.first)[numbers])[numbers == 0]
        start, end = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        end[order] = upto
        start[order] = np.concatenate([[0], upto])[:-1]
        return self.pieces.ids(numbers), start, end

    def _learn(self, chunks: list[bytes]) -> None:
        machine = self.machine
        ranks = machine.ranks([folded(c) for c in chunks])
        lacks = ranks < 0
        ids, start, end = self._unseen([chunks[i] for i in np.flatnonzero(lacks).tolist()])
        starts, ends = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[lacks], ends[lacks] = start + len(machine.ids), end + len(machine.ids)
        starts[~lacks], ends[~lacks] = machine.offsets[ranks[~lacks]], machine.offsets[ranks[~lacks] + 1]
        flat = np.concatenate([machine.ids, ids])[spans(starts, ends - starts)]
        self.known.learn(flat, np.concatenate([[0], np.cumsum(ends - starts)]), sum(map(len, chunks)))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        off, data = wordhash.buffers(texts)
        lo = 0
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + 4 * wordhash.BLOCK, "right")) - 1)
            if self.known.full():
                self.known = Memory()
            numbers = [self.known.numbers(data[a:b].tobytes().split()) for a, b in zip(off[lo:hi], off[lo + 1 : hi + 1], strict=True)]
            new = self.known.unlearned()
            for i in range(0, len(new), TURN):
                self._learn(new[i : i + TURN])
            yield from map(self.known.ids, numbers)
            lo = hi


def decode(ids: np.ndarray, tokens: list[str] | np.ndarray) -> str:
    """The tokens joined by spaces, as a file without a decoder has it."""
    return " ".join(np.asarray(tokens, object)[ids])


def prepared(docs: DataFrame, vocabulary_path: str, text: str = "text") -> tuple[bytes, Vocabulary]:
    vocabulary = Vocabulary.read(vocabulary_path)
    return compile_lexicon(frequent(docs, text), vocabulary), vocabulary


def _workers(spark: SparkSession, image: bytes, vocabulary: Vocabulary):
    held = spark.sparkContext.broadcast((image, vocabulary))
    return lambda: Encoder(*held.value)


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with ``out``, the array of ids of each text."""
    make = _workers(docs.sparkSession, *prepared(docs, vocabulary_path, text))
    names = [c for c in docs.columns if c != out]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            ids = list(encoder.encode(batch.column(at)))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
            values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, values)], names=[*names, out])

    return docs.mapInArrow(store.frugal(run), T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def digest(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, the number of ids, and the hashes of the ids and of the decoded text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    make = _workers(docs.sparkSession, *prepared(docs, vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        tokens = np.array(encoder.vocabulary.tokens, object)
        for batch in batches:
            n, a, b = [], [], []
            for ids in encoder.encode(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(decode(ids, tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(store.frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
