"""The ten operators against plain Python, on small tables with odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codevane.llm import bpe, components, language, licenses, mixing, pii, quality, sharding, similarity, substrings, topk, wordhash

BREAK = "[^\x20\x09-\x0d]+"
ODD = [None, "", "   ", "one", "ONE two", "\n\nq\nq", "é€😀 x", "x " * 60, "y\x0bz\x0cz"]


def words(t):
    return re.findall(BREAK, t or "")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    """Documents of the smallest folder and odd rows: nulls, repeats, long texts, clashing column names."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    long = "word a@b.org 4111 1111 1111 1111 under the mit license " * 4000
    rows = [(10**6 + i, t, None if i % 2 else "en", None if i % 3 else "src0", None) for i, t in enumerate([*ODD, long])]
    rows += [(None, "text without an id", "en", "src1", 1), (10**6 + 7, "x " * 60, "en", "src0", 1)]
    odd = spark.createDataFrame(rows, base.schema)
    both = base.unionByName(odd).unionByName(base.limit(3))
    clash = {c: F.lit("clash") for c in ("id", "n", "key", "row", "hash", "label", "word", "token", "pos", "code", "at", "component")}
    return both.withColumns(clash).cache()


def empty(df):
    return df.where("false")


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii(spark, docs):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    more = ["a@b.cd_e@f.gh x@y x@y.z 300.1.1.1.5 1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.255 +1 (555) 123-4567", "é😀 4111-1111-1111-1111 12 4111 1111 1111 1112", "000255.1.1.01"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(2 * 10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))

    def expect(t):
        t, spans, n = t or "", [], Counter()
        for k, p in kinds.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if k == "ip" and max(map(int, m.group().split("."))) > 255 or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                    continue
                n[k] += 1
                spans.append(f"{k}:{m.start()}:{m.end()}")
        return (*[n[k] for k in kinds], hashlib.sha256(",".join(spans).encode()).hexdigest())

    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(df).collect())
    assert got == Counter((r.doc_id, *expect(r.text)) for r in df.collect())
    assert pii.digest(empty(docs)).count() == 0


def test_pii_own_kinds_and_mask(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    want = {
        "pay DE89 3704 0044 0532 0130 00 now": ("iban:4:31", "pay <iban> now"),
        "DE89 3704 0044 0532 0130 01": ("", None),
        "BE68 5390 0754 7034 PAID": ("iban:0:19", "<iban> PAID"),
        "BE68539007547034, 12": ("iban:0:16", "<iban>, 12"),
        "BE68 5390 0754 7034PAID": ("", None),
        "NO93 8601 1117 947 IS MINE": ("iban:0:18", "<iban> IS MINE"),
        "ssn 123-45-6789": ("ssn:4:15", "ssn <ssn>"),
        "part 123-45-6789": ("", None),
        None: ("", None),
        "a@b.cd and 1.2.3.4": ("email:0:6,ip:11:18", "<email> and <ip>"),
        f'token = "{key}" and': ("secret:9:49", 'token = "<secret>" and'),
        f"API_KEY: {key.upper()}": ("secret:9:49", "API_KEY: <secret>"),
        f"commit {key} and then": ("", None),
        "token = counterrevolutionaries": ("", None),
        "password=Zm9vYmFyYmF6cXV4MTIzNA==;": ("secret:9:33", "password=<secret>;"),
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string").withColumn("spans", F.lit("mine"))
    spans = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    for i, (text, (s, m)) in enumerate(want.items()):
        assert (spans[i], masked[i]) == (s, text if m is None else m), text
    assert pii.mask(df).columns == df.columns


def test_pii_mask_of_long_and_overlapping_texts(spark):
    """Against a plain pass over the spans, with texts of several parts and characters beyond the first plane."""
    rnd = random.Random(4)
    pieces = ["a@b.cd ", "1.2.3.4 ", "+1 4111 1111 1111 1111 ", "4111111111111111 ", "😀é ", "x" * 70 + " ", "x@1.2.3.4 "]
    texts = ["".join(rnd.choice(pieces) for _ in range(n)) for n in (1, 3, 70, 500, 4000)] + ["plain " * 3000 + "a@b.cd", "a@b.cd" + " plain" * 3000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    for r in pii.detect(df).collect():
        at, out = 0, []
        for s in sorted(r.spans, key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out += [r.text[at : s.start], f"<{s.kind}>"]
            at = max(at, s.end)
        assert masked[r.doc_id] == "".join(out) + r.text[at:]


def test_pii_of_many_matches_in_one_text(spark):
    n = 50_000
    df = spark.createDataFrame([(1, "".join(f"u{i}@mail.org 1.2.3.4\n" for i in range(n)))], "doc_id long, text string")
    began = time.perf_counter()
    r = pii.digest(df).first()
    assert (r.n_email, r.n_ip) == (n, n) and time.perf_counter() - began < 60
    assert pii.mask(df).first().text == "<email> <ip>\n" * n


def test_topk(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.digest(e).collect())) == sorted(c.sql(topk.SQL).fetchall())
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (100, [1.0]), (200, None), (300, [nan]), (400, []), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [None, 1.0]), (None, [1.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in topk.digest(odd).orderBy("query_id", "rank").collect()]
    s = 1024 * 1024
    assert got[:4] == [(0, 1, 5, 5 * s), (0, 2, 5, 5 * s), (0, 3, 100, s), (0, 4, 400, 0)]
    assert got[4:] == [(100, 1, 0, s), (100, 2, 5, s), (100, 3, 5, s), (100, 4, 400, 0), (400, 1, 0, 0), (400, 2, 5, 0), (400, 3, 5, 0), (400, 4, 100, 0)]
    assert topk.digest(empty(e)).count() == 0


def best_of(x, q, k):
    """The exact scores of all rows but q, best first."""
    x = [[math.floor(Fraction(v) * 1024) for v in r] for r in x]
    s = {i: sum(a * b for a, b in zip(x[q], r)) for i, r in enumerate(x) if i != q}
    return [(i, s[i]) for i in sorted(s, key=lambda i: (-s[i], i))[:k]]


@pytest.mark.parametrize("scale", [1.0, 0.01, 1e5, 1e8, 1e200])
def test_topk_scores_are_exact(spark, monkeypatch, scale):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 6)) * scale
    x[::7] = rng.normal(size=x[::7].shape)  # a mixture of magnitudes
    x[5], x[50] = 1e5, -1e308
    monkeypatch.setattr(topk, "VECTORS", 16)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=5).collect()}
    for q in range(0, 120, 20):
        want = [(i, max(-(2**63), min(2**63 - 1, s))) for i, s in best_of(x.tolist(), q, 5)]
        assert [got[q, r + 1] for r in range(5)] == want


def test_topk_stops_early_on_skewed_vectors():
    """Few components carry the scores: half of the lists is not read, with and without a bar."""
    rng = np.random.default_rng(9)
    x = np.floor(1024 * rng.pareto(2.0, size=(4000, 4)) * [30, 5, 1, 1])
    q = x[:50]
    for bars in ([None] * 50, [sorted(x @ v)[-20] for v in q]):
        depth = []
        for i, ids, score, d in topk.aggregate(x, np.arange(4000), q, np.arange(50), 10, list(bars)):
            s = x @ q[i]
            s[i] = -1
            assert score.tolist() == sorted(s.tolist(), reverse=True)[:10]
            depth.append(d)
        assert len(depth) == 50 and np.mean(depth) < 0.5


def test_topk_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, size=(300, 5)).astype(float)
    monkeypatch.setattr(topk, "VECTORS", 32)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "HELD", 3)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0, k=4).collect()}
    assert len(got) == 24
    for q in range(0, 300, 50):
        assert [got[q, r + 1] for r in range(4)] == best_of(x.tolist(), q, 4)


def jaccard(rows, rule):
    sets, up, at = [], {}, defaultdict(list)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in rows:
        w = words(lowered(t))
        k = rule.words
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
        up[i] = i
    for n, s in enumerate(sets):
        if rows[n][0] is None:
            continue
        for m, c in Counter(m for g in s for m in at[g]).items():
            if rule.den * c >= rule.num * (len(s) + len(sets[m]) - c):
                a, b = sorted((root(rows[n][0]), root(rows[m][0])))
                up[b] = a
        for g in s:
            at[g].append(n)
    return Counter((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("rule", [similarity.Rule(3, 90, 100), similarity.Rule()])
def test_similarity(spark, docs, rule):
    rnd, more = random.Random(3), []
    for _ in range(8):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(8, 200))]
        for _ in range(6):
            c = list(base)
            for _ in range(rnd.randrange(0, 3)):
                c[rnd.randrange(len(c))] = f"n{rnd.randrange(5)}"
            more.append(" ".join(c).upper() if rnd.random() < 0.2 else " ".join(c))
    df = docs.select("doc_id", "text", "n", "id").unionByName(spark.createDataFrame([(2 * 10**6 + i, t, "", "") for i, t in enumerate(more)], "doc_id long, text string, n string, id string"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in similarity.join(df, rule).collect())
    assert got == jaccard([(r.doc_id, r.text) for r in df.collect()], rule)


def check_similarity(spark, texts, rule):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in similarity.join(df, rule).collect())
    assert got == jaccard(list(enumerate(texts)), rule)
    return got


def test_members_of_one_group_are_compared(spark):
    """Documents that are alike only with each other, in a group whose prefix no other group has."""
    head = " ".join(f"h{i}" for i in range(7))
    a, b = ([f"{x}{i}" for i in range(35)] for x in "ab")
    texts = [f"{head} {' '.join(w)}" for w in (a, b, [*b[:-1], "other"])]
    for j, body in enumerate((a, b, [*b[:-1], "other"])):
        texts += [" ".join(["h5", "h6", *body, *(f"f{j}x{k}x{i}" for i in range(80))]) for k in range(6)]
    got = check_similarity(spark, texts, similarity.Rule(3, 90, 100))
    assert (2, 40, 1) in got


@pytest.mark.parametrize("limits", [{}, {"SHORT": 2, "SLICE": 3, "FAN": 2}])
@pytest.mark.parametrize("rule", [similarity.Rule(3, 90, 100), similarity.Rule()])
def test_groups_of_several_clusters(spark, monkeypatch, rule, limits):
    """Equal prefixes of rare words before bodies of common ones, some alike and some not."""
    for k, v in limits.items():
        monkeypatch.setattr(similarity, k, v)
    rnd, texts, bodies = random.Random(11), [], []
    for g in range(4):
        head = [f"rare{g}x{i}" for i in range(12)]
        for c in range(4):
            body = [f"b{c}w{i}" for i in range(60)]
            for _ in range(5):
                own = list(body)
                for _ in range(rnd.randrange(0, 4)):
                    own[rnd.randrange(40, 60)] = f"z{rnd.randrange(3)}"
                bodies.append(own)
                texts.append(" ".join(head + own))
    for own in bodies[:40]:
        texts += [" ".join([*own, *(f"f{len(texts)}x{k}" for k in range(120))]) for _ in range(3)]
    check_similarity(spark, texts, rule)


def test_long_patterned_words_differ(spark):
    """Words whose polynomials modulo 2**64 are equal for every odd base."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert [x[2] for x in sorted(check_similarity(spark, [a, b, a], similarity.Rule(3, 90, 100)))] == [0, 1, 0]
    w = " w" * 60
    rows = substrings.digest(spark.createDataFrame([(0, a + w), (1, b + w), (2, "c" + w)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {0: 0, 1: 60, 2: 60}


def test_an_id_with_several_texts_is_one_document(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    df = spark.createDataFrame([(7, x), (7, y), (3, x), (9, y + " end"), (5, z)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in similarity.join(df, similarity.Rule(3, 90, 100)).collect())
    assert got == Counter([(7, 3), (7, 3), (3, 3), (9, 3), (5, 5)])


def test_similarity_empty(docs):
    assert similarity.digest(empty(docs)).count() == 0


def test_components(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_language(spark, sf, docs):
    base = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = language.digest(base).join(base.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)
    odd = {r.doc_id: r for r in language.digest(docs).where("doc_id >= 1000000").collect()}
    assert odd[10**6].lang_pred == odd[10**6 + 1].lang_pred == language.UNKNOWN and odd[10**6 + 6].lang_pred != language.UNKNOWN
    assert all(0 <= r.score <= 1 for r in got)
    assert language.digest(empty(docs)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.digest(none).collect()} == {language.UNKNOWN}


def folded(text):
    """A text's bytes with letters lowered, and all but letters and bytes beyond ASCII as blanks."""
    return bytes(b if b > 127 else b | 32 if chr(b).isalpha() else 32 for b in text.encode())


def grams_of(text):
    f = folded(text)
    return [int.from_bytes(f[i : i + 4], "big") for i in range(len(f) - 3) if f[i : i + 4] != b"    "]


def spots_of(code):
    return [((code + 1) * int(m) % 2**64) >> 45 for m in language._MULTIPLIERS]


def test_language_model_and_verdicts_by_hand(spark):
    """Filters, corrections and decisions against plain Python, with more than 64 languages and a tie."""
    rnd = random.Random(6)
    alphabets = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñ", 7)) for _ in range(70)]

    def text(letters):
        return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(12))

    rows = [(i, text(alphabets[i % 70]), f"l{i % 70:02d}") for i in range(280)] + [(900, "qqqqq wwwww", "tie1"), (901, "qqqqq wwwww", "tie2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, training=F.lit(True))
    assert model.languages == tuple(sorted({r[2] for r in rows}))
    counts = {x: Counter(g for _, t, y in rows if y == x for g in grams_of(t)) for x in model.languages}
    share = {x: {g: n / sum(c.values()) for g, n in c.items() if n >= language.MIN_SHARE * sum(c.values())} for x, c in counts.items()}
    most = Counter()
    for s in share.values():
        for g, v in s.items():
            most[g] = max(most[g], v)
    marked = [{p for g, v in share[x].items() if v >= language.RELATIVE * most[g] for p in spots_of(g)} for x in model.languages]
    for i, spots in enumerate(marked):
        assert set(np.flatnonzero(model.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)).tolist()) == spots
    asked = [text(a) for a in alphabets[:40]] + ["qqqqq wwwww", "", "123 456", "ab", "äö 12", None, "Qqqqq, " * 40]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(asked):
        g = grams_of(t or "")
        if not any(c.isalpha() for c in t or ""):
            want, score = language.UNKNOWN, 0.0
        else:
            hits = [sum(all(p in spots for p in spots_of(x)) for x in g) for spots in marked]
            true = [max(0.0, (h - len(g) * r) / (1 - r)) for h, r in zip(hits, ((len(s) / language.POSITIONS) ** language.HASHES for s in marked))]
            top = max(true)
            want = model.languages[true.index(top) if top > 0 else model.commonest]
            score = min(1.0, top / max(1, len(g)))
        assert got[i].lang_pred == want and got[i].score == pytest.approx(score), t
    assert got[40].lang_pred == "tie1"


def test_words_longer_than_a_part(monkeypatch):
    import pyarrow as pa

    from codevane.llm import wordhash

    word = "".join(random.Random(3).choice("abcdef") for _ in range(5000))
    want = next(wordhash.blocks(pa.array([f"x {word} {word}"]))).hash
    monkeypatch.setattr(wordhash, "LONG", 700)
    assert next(wordhash.blocks(pa.array([f"x {word} {word}"]))).hash.tolist() == want.tolist() and want[1] == want[2]


def test_language_ignores_other_columns(docs):
    model = language.fit(docs)
    a = docs.select("text", F.lit("x").alias("lang"), F.lit(1).alias("doc_id"))
    want = Counter((r.text, r.lang_pred, r.score) for r in language.predict(docs, model).collect())
    assert Counter((r.text, r.lang_pred, r.score) for r in language.predict(a, model).collect()) == want


def level(sizes):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    w, budget, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        rest, total = budget - sum(full.values()), sum(w[s] for s in free)
        over = {s: 2.0 * sizes[s] for s in free if w[s] / total * rest > 2 * sizes[s]}
        if not over:
            return full | {s: w[s] / total * rest for s in free}
        full |= over


def test_mixing(docs):
    got, rows = mixing.digest(docs).collect(), docs.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = level(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert Counter((r.source_size, round(r.target, 6)) for r in got) == Counter((sizes[r.source], round(want[r.source], 6)) for r in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r.size)
    # documents are taken whole, so a source that one document fills can miss by half of it
    assert all(abs(n - k[1]) <= max(0.02 * k[1], largest[k] / 2) for k, n in taken.items())
    assert sum(abs(n - k[1]) <= 0.02 * k[1] + 5 for k, n in taken.items()) >= len(taken) - 3
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(mixing.digest(docs).collect(), key=key)
    assert mixing.digest(empty(docs)).count() == 0


def test_mixed_rows_match_the_plan(docs):
    small = docs.select("doc_id", "text", "source")
    copies = Counter(r.doc_id for r in mixing.mixed(small, shards=4).collect())
    assert copies == Counter({k: n for k, n in Counter(x for r in mixing.plan(small, shards=4).collect() for x in [r.doc_id] * len(r.shards)).items() if n})


def test_splitting_tree_is_exact():
    q = np.array([7, 0, 100, 33])
    shares = mixing.even(int(q.sum()), 6)
    out = mixing.split(q, shares, np.random.default_rng(1))
    assert out.shape == (6, 4) and (out.sum(axis=0) == q).all() and (out >= 0).all() and (out.sum(axis=1) == shares).all()
    assert shares.max() - shares.min() <= 1


@pytest.mark.parametrize("bins", [2, 4096])
def test_targets_of_many_sources(spark, monkeypatch, bins):
    """Order, weights and level against the plain rule, and quotas dealt by groups."""
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "GROUP", 7)
    rnd = random.Random(14)
    sizes = {f"s{rnd.randrange(10**6)}é{i}": rnd.choice([0, 1, 5, 5, rnd.randrange(1000), rnd.randrange(10**9)]) for i in range(150)} | {None: 77, "": 3}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = level(sizes)
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    assert sorted((r["rank"], r.source) for r in rows if r.source is not None) == list(enumerate(names[:-1])) and len(rows) == 152
    assert all(r.target == pytest.approx(want[r.source], rel=1e-9) for r in rows)
    parts = spark.createDataFrame([(r["rank"], r.source_size) for r in rows], "rank long, words long")
    width = sum(sizes.values()) // 500
    dealt = mixing._bounds(parts, 5, 3, width).collect()
    assert len(dealt) == 152
    each = np.array([np.diff([0, *r.bounds, -(-r.words // width)]) for r in dealt])
    assert (each >= 0).all() and each.sum(axis=0).max() - each.sum(axis=0).min() <= 1


def test_sharding(docs):
    got = sharding.digest(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == docs.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    source = {r.doc_id: r.source for r in docs.collect()}
    mixture = Counter((source[r.doc_id], r.shard) for r in got)
    for s in set(source.values()):
        each = [mixture[s, k] for k in range(8)]
        assert max(each) - min(each) <= 2
    assert sharding.digest(empty(docs)).count() == 0
    few = sharding.digest(docs.limit(3)).collect()
    assert sorted((r.shard, r.slot) for r in few) and len(few) == 3


def test_ranks_of_large_sources_do_not_overflow(spark):
    rnd = random.Random(2)
    rows = [(r, t) for t in (1, 3, 2**32 + 7, 2**40 + 1, 2**46 - 3) for r in (0, t // 3, t // 2, t - 1, rnd.randrange(t))]
    df = spark.createDataFrame(rows, "r long, t long")
    for r, t, f in df.select("r", "t", sharding.fraction(F.col("r"), F.col("t"))).collect():
        assert f == (2 * r + 1) * 2**30 // (2 * t)


def test_sharding_in_many_cells(docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 2)
    monkeypatch.setattr(sharding, "SPAN", 3)
    test_sharding(docs)


def test_licenses(spark, docs):
    more = ["Under the MIT License. under the mit license, CC BY NC! cc by nc by nc; Apache License, Version 2.0", licenses.TEMPLATES["bsd"].replace("source and", "src and"), "É under\x80the mit license", "a b"]
    df = docs.select("doc_id", "text", "label").unionByName(spark.createDataFrame([(2 * 10**6 + i, t, "") for i, t in enumerate([*more, "a b"])], "doc_id long, text string, label string"))

    def expect(t):
        w, spots = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)), []
        for label, p in licenses.PHRASES.items():
            p = p.split()
            spots += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at = [i for i, _ in spots]
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in spots}))

    got = licenses.digest(df).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((r.doc_id, *expect(r.text)) for r in df.collect())
    by = {r.doc_id: r for r in got}
    assert by[2 * 10**6 + 1].labels == "bsd" and 0.6 <= by[2 * 10**6 + 1].score < 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.digest(empty(docs)).count() == 0


def test_license_spans_are_verified(spark):
    cc = "This work is licensed under the Creative Commons {} International License."
    mit = licenses.TEMPLATES["mit"].split()
    want = {
        cc.format("Attribution 4.0"): "cc-by",
        cc.format("Attribution 3.0"): "cc-by",
        cc.format("Attribution-NonCommercial 4.0"): "cc-by-nc",
        cc.format("Attribution-Non-Commercial 4.0"): "cc-by-nc",
        cc.format("Attribution-ShareAlike 4.0"): "cc-by-sa",
        cc.format("Attribution-NonCommercial-ShareAlike 4.0"): "cc-by-nc,cc-by-sa",
        cc.format("Attribution-NoDerivatives 4.0"): "",
        cc.format("Attribution 4.0") + " Noncommercial use is fine. " + cc.format("Attribution-ShareAlike 4.0"): "cc-by,cc-by-sa",
        "so " * 30 + licenses.TEMPLATES["isc"] + " " + licenses.TEMPLATES["gpl"]: "gpl,isc",
        # each part of 5 words votes, but their order is the template's backwards
        " ".join(" ".join(mit[i : i + 5]) for i in range(45, -1, -5)): "",
        " ".join([*mit[:20], "indeed", *mit[20:]]): "mit",
        # every run of 3 words, backwards or in order, with words between
        " ".join(" ".join([*mit[i : i + 3], "a", "b", "c", "d"]) for i in range(len(mit) - 3, -1, -1)): "",
        " ".join(" ".join([*mit[i : i + 3], "a", "b", "c", "d"]) for i in range(len(mit) - 2)): "",
        " ".join(["so", *mit[:15], *"one two three four".split(), *mit[15:30], "five", *mit[30:], "end"]): "mit",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.digest(df).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_licenses_of_a_very_long_text(spark):
    """A text of many licenses takes seconds, and each stands at its place."""
    cc = "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. "
    df = spark.createDataFrame([(1, cc * 15_000), (2, "some plain words " * 70_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert time.perf_counter() - began < 60
    assert [(x.label, x.start) for x in got[1].found[:3]] == [("cc-by-nc", 0), ("cc-by-nc", 14), ("cc-by-nc", 28)] and len(got[1].found) == 15_000
    assert got[2].n_words == 210_000 and not got[2].found


def test_quality(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    def expect(t):
        w, seen, dup, cover = words(t), set(), 0, set()
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        for x in (t or "").split("\n"):
            if words(x):
                dup += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)

    got = quality.digest(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r.doc_id, *expect(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in got)
    known = {r.doc_id: r.quality for r in labels.collect()}
    clean = [r for r in got if known.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in got if known.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean) and sum(r.kept for r in junk) <= 0.2 * len(junk)
    assert quality.digest(empty(docs), labels).count() == 0
    none = quality.digest(docs, empty(labels)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_substrings(spark, docs):
    rnd = random.Random(5)
    ab = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(40, 300))) for _ in range(12)]
    mid, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    more = ["a " * 300, "a " * 49, "a " * 50, "b a " * 60, f"x {'a ' * 77} y", f"q {mid} r", f"s {mid} t", f"q1 {short} r", f"s1 {short} t", mid, "c " * 30 + mid + " c" * 90, "c " * 95, *ab]
    more += [" ".join(x.split()[5:] + y.split()[:60]) for x, y in zip(ab, ab[1:])]
    df = docs.select("doc_id", "text", "row", "at").unionByName(spark.createDataFrame([(2 * 10**6 + i, t, "", "") for i, t in enumerate(more)], "doc_id long, text string, row string, at string"))
    rows, first = [(r.doc_id, words(r.text)) for r in df.collect()], {}
    for i, w in rows:
        for p in range(len(w) - 49 if i is not None else 0):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, i), i)
    want = Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    assert Counter(map(tuple, substrings.digest(df).collect())) == want
    assert substrings.digest(empty(docs)).count() == 0


def test_equal_substrings_share_interior_names(spark):
    """Wherever it stands, in whatever task, a passage has the same symbols and anchors but near its ends."""
    rnd = random.Random(13)
    passage = [f"p{rnd.randrange(40)}" for _ in range(120)]
    texts = [" ".join([f"x{j}x{i}" for i in range(rnd.randrange(0, 90))] + passage + [f"y{j}y{i}" for i in range(30)]) for j in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = substrings.named(substrings._rows(df, "doc_id", "text")).collect()
    length = {i: len(words(t)) for i, t in enumerate(texts)}
    inside = defaultdict(set)
    for r in rows:
        at = r["first"] - (length[r.doc_id] - 150)
        if 0 <= at and at + r.n + substrings.WINDOW - 1 <= 120:
            inside[r.doc_id].add((r.key, at, r.n, bytes(r.content)))
    shared = set.intersection(*inside.values())
    assert len(inside) == 6 and len(shared) >= 2
    assert sum(n for _, _, n, _ in shared) >= 120 - 50 + 1 - 2 * 18


def test_bpe(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    more = [
        "Hello World's don't I'LL <|endoftext|>x<|startoftext|> <|ENDOFTEXT|> <|endoftext|>",
        "ΑΣ ΣΑΣ İstanbul ǅ ﬁ é é ́x  \x85 \x1c a\x1cb",
        "日本語 中文 عربي 123456 ½ ²",
        "a" * 5000 + " " + "!?" * 3000,
        "ẹ́ K ſ ẞ T̈ ẗ T̈ <|ENDOFTEXT|> <|ENDOFTEXT|>",
        "\x00 a\x00b 's's 'S it'S",
    ]
    df = docs.select("doc_id", "text", "word").unionByName(spark.createDataFrame([(2 * 10**6 + i, x, "") for i, x in enumerate(more)], "doc_id long, text string, word string"))

    def expect(x):
        ids = t.encode(x or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, bpe.digest(df, path).collect())) == Counter((r.doc_id, *expect(r.text)) for r in df.collect())
    assert bpe.digest(empty(docs), path).count() == 0


def test_the_lexicon_holds_the_most_frequent_words(spark):
    texts = [f"w{i} " * (400 - i) for i in range(400)] + ["top " * 5000, "once", "a<|b " * 900]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert sorted(bpe.frequent(df, words=100)) == sorted([b"top", *(b"w%d" % i for i in range(99))])
    assert len(bpe.frequent(df)) == 400 and bpe.frequent(df, words=0) == []
    assert bpe.frequent(df.where("false")) == []


def test_transducer():
    rnd = random.Random(9)
    lexicon = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 8))): [rnd.randrange(100) for _ in range(rnd.randrange(4))] for _ in range(300)}
    m = bpe.mapped(bpe.Transducer.build(lexicon))
    asked = [*lexicon, b"", b"zz", b"abcabcabcabc", *(w + b"x" for w in list(lexicon)[:20])]
    for w, r in zip(asked, m.ranks(asked).tolist()):
        assert (r >= 0) == (w in lexicon)
        if r >= 0:
            assert m.ids[m.offsets[r] : m.offsets[r + 1]].tolist() == lexicon[w]
    assert bpe.mapped(bpe.Transducer.build({})).ranks([b"a"]).tolist() == [-1]


def test_unseen_words_are_merged_together(monkeypatch):
    """Words outside the lexicon cost no walk of their own, and get the library's ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t, v, rnd = Tokenizer.from_file(path), bpe.Vocabulary.read(path), random.Random(5)
    ends = ["", "", ",", "...", "'s", "'RE", "$$", "7", "<|endoftext|>", "\u0301", "\x85x"]
    letters = ["etaoin shrdlu", "abAB", "\u00e9\u00e8\u00fco\u0308TH\u0308", "\u65e5\u672c\u8a9e\u03a3\u0130", "!?#.'"]
    lines = [" ".join("".join(rnd.choices(rnd.choice(letters), k=rnd.randrange(1, 14))) + rnd.choice(ends) for _ in range(60)) for _ in range(200)]
    monkeypatch.setattr(bpe, "MEMORY", 3000)
    encoder, calls, merge = bpe.Encoder(bpe.Transducer.build({}), v), [], bpe.Vocabulary.merge
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, piece: calls.append(piece) or merge(self, piece))
    monkeypatch.setattr(wordhash, "BLOCK", 8192)
    got = list(encoder.encode(pa.array([*lines, None, "", " \n", *lines[:9]])))
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in [*lines, "", "", "", *lines[:9]]]
    assert not calls


def test_merging_together_is_merging_one_by_one(monkeypatch):
    v, rnd = bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    pieces = ["".join(rnd.choices(rnd.choice(["ab", "aeinrst", "a", "\u00e9x\u65e5", "\x00#!"]), k=n)) for n in [*range(1, 80), 500] for _ in range(12)]
    for cells in (bpe.CELLS, 128):
        monkeypatch.setattr(bpe, "CELLS", cells)
        ids, first = v.merge_all([*pieces, 49407])
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [*map(v.merge, pieces), [49407]]
    assert [x.tolist() for x in v.merge_all([])] == [[], [0]]


def test_log_ratio_is_of_two_multinomials():
    ratio = np.zeros(quality.BUCKETS, np.int64)
    m = quality.measure(__import__("pyarrow").array(["abc", None]), ratio)
    assert m["n_grams"].tolist() == [1, 0] and math.isclose(m["sum"][0], 0)
