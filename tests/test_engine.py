"""Operators against plain Python on small tables."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codevane.operators import encode, evaluate, index, metrics, prep, quantize, search, sparse, training
from codevane.sources import tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv_round_trip(spark, tmp_path):
    p = write(tmp_path / "c.tsv", 'a\tone\nb\t"two\tx\ny ""q"""\na\tthree\n')
    rows = tables.last_wins(tables.read_tsv(spark, p, 2).select(F.col("c0").alias("k"), F.col("c1").alias("v"), "line"), "k", "v")
    assert {r.k: r.v for r in rows.collect()} == {"a": "three", "b": 'two\tx\ny "q"'}
    r = write(tmp_path / "q.tsv", "1\t0\tp1\t1\n1\t0\tp0\t1\n2\t0\tp1\t1\n1\t0\tp1\t1\n")
    m = tables.multimap(tables.read_tsv(spark, r, 4).select(F.col("c0").alias("qid"), F.col("c2").alias("pid"), "line"), "qid", "pid")
    assert {x.qid: x.pids for x in m.collect()} == {"1": ["p1", "p0", "p1"], "2": ["p1"]}


def test_collection(spark, tmp_path):
    write(tmp_path / "collection.tsv", "p1\tfirst\np2\tsecond\n")
    for n in ("train", "dev.small"):
        write(tmp_path / f"queries.{n}.tsv", f"q{n[0]}\task\n")
        write(tmp_path / f"qrels.{n}.tsv", f"q{n[0]}\t0\tp1\t3\n")
    c = tables.Collection.read(spark, str(tmp_path))
    assert c.passages.count() == 2
    dev = c.mode("dev")
    assert [(r.qid, r.pid, r.rel) for r in dev.qrels.collect()] == [("qd", "p1", 1)]
    c.register()
    assert spark.sql("select count(*) n from queries").first().n == 2
    assert c.samples(1)["passages"].count() == 1
    with pytest.raises(ValueError):
        c.mode("test")


def test_negatives_stop_one_short(spark, tmp_path):
    p = write(tmp_path / "n.jsonl", "\n".join(json.dumps({"qid": i, "pos": [1], "neg": {"bm25": [2, 3]}}) for i in range(5)))
    assert tables.read_negatives(spark, p).count() == 5
    assert tables.read_negatives(spark, p, 3).count() == 2


def test_cache_and_checkpoints(spark, tmp_path):
    calls = []

    def compute(mode, kind):
        calls.append((mode, kind))
        return spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")

    c = tables.EmbeddingCache(spark, str(tmp_path / "e"), compute)
    assert c.dimension() == 2 and c.load("dev", "passage").count() == 1
    assert calls == [("dev", "passage")]
    c.load_all("dev")
    assert len(calls) == 3 and len(c.load_all("dev")) == 2 and len(calls) == 3
    k = tables.Checkpoints(spark, str(tmp_path / "k"), keep=2)
    for step, loss in ((1, 0.1), (2, 3.0), (3, 2.0)):
        k.save(step, {"w": compute("dev", "query")}, loss)
    assert k.steps() == [1, 2, 3] and k.best() == 1
    k.save(4, {"w": compute("dev", "query")}, 0.05)
    assert k.steps() == [3, 4] and k.best() == 4
    assert k.load(4, "w").count() == 1
    shape = tables.shapes(c.load("dev", "passage")).first()
    assert tuple(shape) == (1, 1, 2, 2)


def test_writing_keeps_the_old_table_until_the_new_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_artefact(spark.range(3), path)
    assert tables.write_artefact(spark.read.parquet(path).select((F.col("id") + 1).alias("id")), path).agg(F.sum("id")).first()[0] == 6
    with pytest.raises(PySparkException):
        tables.write_artefact(spark.range(2).select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert spark.read.parquet(path).count() == 3


def test_train_queries_are_not_searched(spark, tmp_path):
    def compute(mode, kind):
        return spark.createDataFrame([(1, [1.0, 2.0, 9.0, 9.0])], "id long, embedding array<double>")

    c = tables.EmbeddingCache(spark, str(tmp_path / "e"), compute)
    book = spark.createDataFrame([(0, [1.0, 2.0]), (1, [9.0, 8.0])], "code int, v array<double>")
    assert [r.code for r in evaluate.codes_of(c, book, 2, "dev", "query").orderBy("chunk_no").collect()] == [0, 1]
    assert evaluate.codes_of(c, book, 2, "train", "passage").count() == 2
    with pytest.raises(ValueError):
        evaluate.codes_of(c, book, 2, "train", "query")


def test_from_embeddings_to_metrics(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 4))
    p = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "pid long, embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "qid long, embedding array<double>")
    qrels = spark.createDataFrame([(i, i) for i in range(5)], "qid long, pid long")
    got = {(r.metric, r.k): r.value for r in evaluate.evaluate("dense", p, q, qrels, (10, 30)).collect()}
    assert got["recall", 30] == 1.0
    book = spark.createDataFrame([(i, x[i, :2].tolist()) for i in range(8)], "code int, v array<double>")
    run = evaluate.run_of("vq", p, q, 30, codebook=book, chunks=2, pad=True)
    assert run.count() == 150
    assert {(r.metric, r.k) for r in evaluate.evaluate("vq", p, q, qrels, (10,), codebook=book, chunks=2).collect()} == {(m, 10) for m in ("mrr", "ndcg", "recall")}
    with pytest.raises(ValueError):
        evaluate.run_of("bm25", p, q)
    with pytest.raises(ValueError):
        evaluate.run_of("vq", p, q)
    many = [(i, [float(i)]) for i in range(9)]
    assert quantize.state(spark.createDataFrame(many, "code int, v array<double>")).embed.ravel().tolist() == list(range(9))
    with pytest.raises(ValueError):
        quantize.state(spark.createDataFrame(many[1:], "code int, v array<double>"))


def test_a_large_codebook_is_searched_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    book = spark.createDataFrame([(i, rng.integers(0, 3, 2).astype(float).tolist()) for i in range(20)], "code int, v array<double>")
    x = spark.createDataFrame([(i, 0, rng.normal(size=2).tolist()) for i in range(40)] + [(99, 0, [1.0, 1.0])], "id long, chunk_no int, v array<double>")
    want = {r.id: r.code for r in quantize.assign_sql(x, book).collect()}
    monkeypatch.setattr(quantize, "SENT_VALUES", 8)
    assert {r.id: r.code for r in quantize.assign(x, book).collect()} == want


def test_triplets(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in (1, 10, 30, 31)], "pid long, text string")
    queries = texts.withColumnRenamed("pid", "qid")
    there = spark.createDataFrame([(1, [10], [30, 31])], "qid long, pos array<long>, neg array<long>")
    r = prep.triplets(there, queries, texts).first()
    assert (r.query, r.positive, sorted(r.negatives)) == ("t1", "t10", ["t30", "t31"])
    pairs = spark.createDataFrame([(1, 10, "pos"), (1, 31, "neg"), (1, 30, "neg")], "qid long, pid long, role string")
    assert prep.looked_up(prep.drawn_pairs(pairs), queries, texts).first() == r
    lost = {"positive": ([11], [30]), "negative": ([10], [30, 32])}
    for name, (pos, neg) in lost.items():
        df = spark.createDataFrame([(1, pos, neg)], "qid long, pos array<long>, neg array<long>")
        with pytest.raises(PySparkException):
            prep.triplets(df, queries, texts).collect()
        left = prep.triplets(df, queries, texts, strict=False).collect()
        assert [(x.positive, x.negatives) for x in left] == ([] if name == "positive" else [("t10", ["t30"])])
    other = spark.createDataFrame([(2, [10], [30])], "qid long, pos array<long>, neg array<long>")
    with pytest.raises(PySparkException):
        prep.triplets(other, queries, texts).collect()
    assert prep.triplets(other, queries, texts, strict=False).count() == 0


def test_teacher_triples(spark, tmp_path):
    p = write(tmp_path / "t.tsv", "9.5\t1.25\t1\t10\t30\n8.0\t2.0\t2\t11\t31\n")
    assert [tuple(r) for r in tables.read_teacher_triples(spark, p).orderBy("qid").collect()] == [(1, [10], [30]), (2, [11], [31])]
    tables.append_metrics(spark.createDataFrame([("mrr", 10, 0.5)], "metric string, k int, value double"), str(tmp_path / "m"))
    tables.append_metrics(spark.createDataFrame([("mrr", 10, 0.6)], "metric string, k int, value double"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_choice_of_passages(spark):
    passages = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "pid string, text string")
    qrels = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "c")], "qid string, pid string")
    assert {r.pid for r in prep.search_pool(passages, qrels, "train").collect()} == {"a", "c"}
    assert prep.search_pool(passages, qrels, "dev").count() == 3
    with pytest.raises(ValueError):
        prep.judged_passages(passages.where("pid = 'a'"), qrels, strict=True)
    with pytest.raises(ValueError):
        prep.window(passages, "pid", None, 2)
    assert [r.pid for r in prep.window(passages, "pid", 1, 1).collect()] == ["b"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(6)]), (2, [9.0] * 6)], "id long, embedding array<double>")
    c = quantize.chunk(df, 3)
    assert c.where("id = 1 and chunk_no = 2").first().v == [4.0, 5.0]
    assert {r.id: r.embedding for r in quantize.unchunk(c).collect()}[1] == [float(i) for i in range(6)]
    with pytest.raises(PySparkException):
        quantize.chunk(df, 4).collect()


def test_assignment_ties_and_identity(spark):
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], "code int, v array<double>")
    x = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.1]), (3, 0, [0.0, 0.0])], "id long, chunk_no int, v array<double>")
    for f in (quantize.assign, quantize.assign_sql):
        assert {r.id: r.code for r in f(x, book).collect()} == {1: 0, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        quantize.assign(x, book.limit(0))


@pytest.mark.parametrize("start,reset", [(0.0, False), (1.0, True)])
def test_running_means(spark, start, reset):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(23, 2))
    q = quantize.Quantizer(3, 2, initial_size=start, reset_dead=reset, dead_below=0.95)
    df = spark.createDataFrame([(i, 0, x[i].tolist()) for i in range(23)], "id long, chunk_no int, v array<double>")
    got = quantize.fit_exact(q, q.started(x[:3]), df, ["id", "chunk_no"], batch=10)
    e, size, sums = x[:3].copy(), np.full(3, start), x[:3].copy()
    for step, i in enumerate((0, 10, 20)):
        b = x[i : i + 10]
        near = ((b[:, None] - e[None]) ** 2).sum(-1).argmin(1)
        size = 0.99 * size + 0.01 * np.bincount(near, minlength=3)
        sums = 0.99 * sums + 0.01 * np.stack([b[near == c].sum(0) for c in range(3)])
        n = size.sum()
        e = sums / ((size + 1e-5) / (n + 3e-5) * n)[:, None]
        dead = np.flatnonzero(size < 0.95)
        if reset and len(dead):
            rows = b[np.random.default_rng((0, step)).integers(0, len(b), len(dead))]
            e, size, sums = e.copy(), size.copy(), sums.copy()
            e[dead], size[dead], sums[dead] = rows, 1.0, rows
    assert np.allclose(got.embed, e) and np.allclose(got.size, size) and np.allclose(got.sums, sums)
    one = quantize.fit_macro(q, q.started(x[:3]), [df])
    again = quantize.fit_exact(q, q.started(x[:3]), df, ["id", "chunk_no"], batch=1000)
    if not reset:
        assert np.allclose(one.embed, again.embed)


def codes(spark):
    return spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 2), (2, 0, 2), (2, 1, 3), (2, 2, 3)], "id long, chunk_no int, code int")


def test_index(spark):
    tf = index.term_frequency(codes(spark))
    assert {(r.id, r.code): r.weight for r in tf.collect()} == {(1, 5): 2.0, (1, 2): 1.0, (2, 2): 1.0, (2, 3): 2.0}
    assert sorted(map(tuple, index.from_postings(index.postings(tf)).collect())) == sorted((r.id, r.code, r.weight) for r in tf.collect())
    with pytest.raises(PySparkException):
        index.checked_vocabulary(codes(spark), 5).collect()
    with pytest.raises(ValueError):
        index.checked_vocabulary(codes(spark), None)
    assert index.sparsity(tf, spark.range(4)).first().mean_nonzero == 1.0


def test_search_pads_and_breaks_ties(spark):
    q = spark.createDataFrame([("q", 1, 2.0), ("r", 9, 1.0)], "qid string, code int, weight double")
    d = spark.createDataFrame([(3, 1, 1.0), (2, 1, 1.0), (4, 7, 1.0)], "pid long, code int, weight double")
    assert [(r.pid, r.score, r["rank"]) for r in search.sparse_search(q, d, 5).orderBy("rank").collect()] == [(2, 2.0, 1), (3, 2.0, 2)]
    assert search.sparse_search(q, d, 5, salts=3).orderBy("rank").collect() == search.sparse_search(q, d, 5).orderBy("rank").collect()
    maps = {r.qid: r.results for r in search.as_map(search.sparse_search(q, d, 5)).collect()}
    assert maps == {"q": {"2": 2.0, "3": 2.0}}
    padded = search.sparse_search(q, d, 3, d.select("pid")).orderBy("qid", "rank").collect()
    assert [(r.qid, r.pid, r.score) for r in padded] == [("q", 2, 2.0), ("q", 3, 2.0), ("q", 4, 0.0), ("r", 2, 0.0), ("r", 3, 0.0), ("r", 4, 0.0)]


def test_dense_equals_join(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    p = spark.createDataFrame(rows, "pid long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", v) for i, v in rows[:6]], "qid string, embedding array<double>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    got = {(r.qid, r["rank"]): r.pid for r in search.dense_search(p, q, 5).collect()}
    want = {(r.qid, r["rank"]): r.pid for r in search.ranked(search.dense_scores_sql(p, q), 5).collect()}
    assert got == want and len(got) == 30
    # many equal scores, in small parts: the least names stay
    monkeypatch.setattr(search, "SEARCH_ROWS", 3)
    same = p.select("pid", F.transform("embedding", lambda x: F.signum(x)).alias("embedding"))
    ask = q.select("qid", F.transform("embedding", lambda x: F.signum(x)).alias("embedding"))
    got = {(r.qid, r["rank"]): r.pid for r in search.dense_search(same, ask, 5).collect()}
    assert got == {(r.qid, r["rank"]): r.pid for r in search.ranked(search.dense_scores_sql(same, ask), 5).collect()}
    assert search.dense_search(p, q.limit(0), 5).count() == 0


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("a", "x", 1), ("b", "n", 1), ("b", "x", 2), ("c", "n", 1), ("c", "m", 2), ("c", "x", 3)], "qid string, pid string, rank int")
    qrels = spark.createDataFrame([(q, "x") for q in "abcd"] + [("b", "y"), ("b", "y")], "qid string, pid string")
    got = {(r.qid, r.metric): r.value for r in metrics.per_query(run, qrels, (2,)).collect()}
    ideal = 1 + 1 / math.log2(3)
    want = {("a", "mrr"): 1, ("a", "ndcg"): 1, ("a", "recall"): 1, ("b", "mrr"): 0.5, ("b", "ndcg"): 1 / math.log2(3) / ideal, ("b", "recall"): 0.5}
    want |= {(q, m): 0 for q in "cd" for m in ("mrr", "ndcg", "recall")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {r.qid for r in metrics.per_query(run, qrels, (2,), "run").collect()} == set("abc")


def test_projection_and_losses(spark):
    rng = np.random.default_rng(3)
    p = sparse.Projection.initial(4, 6, 1)
    x = rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "id long, embedding array<double>")
    y = p.apply(x)
    got = {(r.id, r.code): r.weight for r in sparse.project(df, p).collect()}
    assert got.keys() == set(zip(*map(lambda a: a.tolist(), np.nonzero(y)))) and all(abs(got[k] - y[k]) < 1e-12 for k in got)
    assert abs(sparse.flops(sparse.project(df, p), 5).first().flops - (np.abs(y).mean(0) ** 2).sum()) < 1e-12
    s = rng.normal(size=(3, 5))
    scores = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(3) for j in range(5)], "i int, j int, score double")
    z = s / 0.05
    want = np.mean([np.log(np.exp(z[i] - z[i].max()).sum()) + z[i].max() - z[i, i] for i in range(3)])
    assert abs(sparse.contrastive(scores).first().loss - want) < 1e-9
    assert sparse.project(df, p, k=1).groupBy("id").count().agg(F.max("count")).first()[0] == 1


def model(**kw):
    s = training.Settings(chunks=2, outputs=6, batch=8, **kw)
    q = quantize.Quantizer(4, 2, initial_size=1.0, reset_dead=True)
    return training.Model(s, q, q.initial(), sparse.Projection.initial(4, 6, 2))


def test_gradients_follow_the_loss():
    rng = np.random.default_rng(4)
    q, p, n = rng.normal(size=(3, 4)), rng.normal(size=(3, 4)), rng.normal(size=(6, 4))
    m = model()
    _, gw, gb = training.losses(m, q, p, n)
    w = m.projection.weight
    for i, j in ((0, 0), (1, 3), (3, 5)):
        step = np.zeros_like(w)
        step[i, j] = 1e-6
        hi, lo = (training.losses(training.Model(m.settings, m.quantizer, m.state, sparse.Projection(w + d * step, m.projection.bias)), q, p, n)[0]["total"] for d in (1, -1))
        assert abs((hi - lo) / 2e-6 - gw[i, j]) < 1e-4
    assert gb.shape == (6,)
    with pytest.raises(ValueError):
        training.Settings(use_quantization=False, codebook_loss=True)


def rows_of_vectors(spark, n):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        v = rng.normal(size=4)
        rows.append((i, v.tolist(), (v + 0.1 * rng.normal(size=4)).tolist(), [rng.normal(size=4).tolist() for _ in range(2)]))
    return spark.createDataFrame(rows, "qid long, query array<double>, positive array<double>, negatives array<array<double>>")


def test_training_lowers_the_loss(spark, tmp_path):
    df = rows_of_vectors(spark, 24)
    saved = tables.Checkpoints(spark, str(tmp_path / "k"), keep=1)
    start = model(epochs=3, use_quantization=False, codebook_loss=False, rate=0.05, warmup=2, every=3)
    first = training.evaluated(start, training.dealt(df, 3, 0))["total"]
    m = training.fit(start, df, df, saved)
    assert [e["step"] for e in m.evaluations] == [3, 6, 9] and len(m.history) == 9
    best = min(m.evaluations, key=lambda e: e["total"])
    assert best["total"] < first and saved.best() == best["step"]
    assert abs(training.evaluated(m, training.dealt(df, 3, 0))["total"] - best["total"]) < 1e-9
    again = training.load(m.settings, m.quantizer, {n: saved.load(saved.best(), n) for n in ("weight", "bias", "codes", "sizes", "sums")})
    assert np.allclose(again.projection.weight, m.projection.weight) and np.allclose(again.state.sums, m.state.sums)
    with pytest.raises(ValueError):
        training.load(m.settings, m.quantizer, {"weight": saved.load(saved.best(), "weight")})
    got = training.encoded(df.select(F.col("qid").alias("id"), F.col("query").alias("embedding")), m)
    assert got.count() > 0


def test_steps_follow_the_schedule(spark):
    """One step against the optimiser's formula, and codes against one update by hand."""
    df = rows_of_vectors(spark, 12)
    m = model(epochs=1, rate=0.1, warmup=0)
    rows = df.orderBy("qid").collect()
    q, p, n = (np.array([r[c] for r in rows]) for c in ("query", "positive", "negatives"))
    n = n.reshape(-1, 4)
    w, state = m.projection.weight, m.state
    loss, gw, _ = training.losses(m, q, p, n)
    x = np.concatenate([q, p, n]).reshape(-1, 2)
    near = quantize.nearest(x, state.embed)
    want = quantize.ema_step(m.quantizer, state, np.bincount(near, minlength=4), np.stack([x[near == c].sum(axis=0) for c in range(4)]))
    got = training.fit(model(epochs=1, rate=0.1, warmup=0, parallel=4), df)
    rate = got.history[0]["rate"]
    assert rate == pytest.approx(0.05) and got.history[0]["total"] == pytest.approx(loss["total"])
    assert np.allclose(got.projection.weight, w * (1 - rate * 0.01) - rate * gw / (np.abs(gw) + 1e-8))
    assert np.allclose(got.state.sums, want.sums)
    s = training.Settings(rate=1.0, warmup=10)
    assert [training.rate_at(s, k, 30) for k in (0, 5, 10, 20, 30)] == [0.0, 0.5, 1.0, 0.5, 0.0]


def test_collated_texts_are_vectors_by_role(spark):
    df = spark.createDataFrame([(1, "a b", "c", ["d", "e"]), (2, None, "x", None)], "qid long, query string, positive string, negatives array<string>")
    e = encode.HashedWords(8)
    got = {r.qid: r for r in training.collate(df, e).collect()}
    assert got[1].query == e.encode(["a b"])[0].tolist() and got[1].negatives == e.encode(["d", "e"]).tolist()
    assert got[2].query == [0.0] * 8 and got[2].negatives == []
    assert training.collate(df.drop("negatives"), e).where("size(negatives) = 0").count() == 2


def test_pooling(spark):
    rows = [(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 4.0], 1), (2, 0, [1.0, 2.0], 1), (2, 1, [9.0, 9.0], 0), (3, 0, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "id long, token int, v array<double>, mask int")
    got = {(r.id, r.d): r.value for r in encode.mean_pool(df).collect()}
    assert got[1, 0] == 2.0 and got[2, 1] == 2.0 and math.isnan(got[3, 0])


def test_encoder(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b a", None, ""])], "id long, text string")
    got = {r.id: r.embedding for r in encode.encode(df, encode.HashedWords(8), batch=3).collect()}
    assert got[0] == got[1] and got[2] == [0.0] * 8 and len(got) == 4


def test_streaming(spark, tmp_path):
    from codevane.streaming import online

    rng = np.random.default_rng(6)
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "id long, embedding array<double>").write.parquet(src)
    stream = spark.readStream.schema("id long, embedding array<double>").parquet(src)
    q = quantize.Quantizer(3, 2, initial_size=1.0)
    online.online_codebook(stream, q, q.initial(), 2, str(tmp_path / "book"), str(tmp_path / "c1")).awaitTermination()
    want = quantize.fit_macro(q, q.initial(), [quantize.chunk(spark.read.parquet(src), 2)])
    rows = spark.read.parquet(str(tmp_path / "book/step=0")).orderBy("code").collect()
    assert np.allclose([r.v for r in rows], want.embed)
    online.append_index(stream, quantize.codebook(spark, want), 2, str(tmp_path / "index"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).agg(F.sum("weight")).first()[0] == 18.0


def test_queries_among_the_passages(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)]
    p = spark.createDataFrame(rows, "pid long, embedding array<double>")
    q = p.where("pid in (2, 5)").withColumnRenamed("pid", "qid")
    got = [(r.qid, r.pid) for r in search.dense_search(p, q, 3, own=False).orderBy("qid", "rank").collect()]
    assert got == [(2, 5), (2, 8), (2, 11), (5, 2), (5, 8), (5, 11)]
    terms = spark.createDataFrame([(1, 7, 2.0), (2, 7, 1.0), (3, 8, 1.0)], "pid long, code int, weight double")
    ask = terms.where("pid <> 2").withColumnRenamed("pid", "qid")
    found = search.sparse_search(ask, terms, 2, terms.select("pid"), own=False).orderBy("qid", "rank").collect()
    assert [(r.qid, r.pid, r.score) for r in found] == [(1, 2, 2.0), (1, 3, 0.0), (3, 1, 0.0), (3, 2, 0.0)]


def some_terms(spark, n, names, signed=False, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(i, names(int(c)), float(rng.integers(-2 if signed else 1, 3))) for i in range(n) for c in rng.choice(9, 4, replace=False)]
    return spark.createDataFrame(rows, f"pid long, code {'int' if names is int else 'string'}, weight double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("names, signed, dense", [(int, False, 2048), (str, False, 2), (int, True, 2048), (str, True, 2)])
def test_sparse_search_makes_no_pairs(spark, monkeypatch, names, signed, dense):
    p = some_terms(spark, 40, names, signed)
    q = p.where("pid % 5 = 0").withColumnRenamed("pid", "qid")
    want = sorted(map(tuple, search.ranked(search.others(search.sparse_scores(q, p)), 7).collect()))
    for name, n in (("QUERY_BLOCK", 3), ("SEARCH_ROWS", 4), ("PART_ROWS", 11), ("DENSE_CODES", dense)):
        monkeypatch.setattr(search, name, n)
    got = search.sparse_search(q, p, 7, own=False)
    assert sorted(map(tuple, got.collect())) == want
    assert "Join" not in plan(got)


def test_padding_joins_no_pairs(spark, monkeypatch):
    p = some_terms(spark, 12, int)
    q = p.where("pid in (1, 6)").withColumnRenamed("pid", "qid")
    ids = spark.range(15).select(F.col("id").alias("pid"))
    every = search.others(q.select("qid").distinct().crossJoin(ids)).join(search.sparse_scores(q, p), ["qid", "pid"], "left")
    want = sorted(map(tuple, search.ranked(every.select("qid", "pid", F.coalesce("score", F.lit(0.0)).alias("score")), 13).collect()))
    monkeypatch.setattr(search, "PART_ROWS", 5)
    got = search.sparse_search(q, p, 13, ids, own=False)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 26
    assert "Join" not in plan(got)


def test_registered_search_of_equal_weights_makes_no_pairs(spark):
    from codevane.plans import registry

    assert "Join" not in plan(registry.QUERIES["q_vq_search_binary"](spark, "/root/testdata/sf0.001"))


def test_scores_are_rounded_before_they_are_ranked(spark, monkeypatch):
    q = spark.createDataFrame([(0, 1, 1.0)], "qid long, code int, weight double")
    p = spark.createDataFrame([(7, 1, 1.000001), (5, 1, 1.0), (6, 1, 1.1), (8, 1, 1e-9), (9, 2, 1.0)], "pid long, code int, weight double")
    monkeypatch.setattr(search, "SEARCH_ROWS", 2)
    got = search.sparse_search(q, p, 4, digits=5)
    assert [(r.pid, r.score) for r in got.orderBy("rank").collect()] == [(6, 1.1), (5, 1.0), (7, 1.0), (8, 0.0)]
    assert "Join" not in plan(got)


@pytest.mark.parametrize("universe", ["qrels", "run"])
@pytest.mark.parametrize("own", [True, False])
def test_labels_judge_like_their_pairs(spark, universe, own):
    labels = [(i, [1, 1, 2, 2, 2, 3, None, 4][i]) for i in range(8)]
    p = spark.createDataFrame([*labels, (1, 1)], "pid long, label int")
    q = spark.createDataFrame([r for r in labels if r[0] != 4], "qid long, label int")
    run = spark.createDataFrame([(i, (i + r) % 9, r) for i in (0, 2, 5, 6, 9) for r in range(1, 6)], "qid long, pid long, rank int")
    qrels = q.join(p, "label").select("qid", "pid")
    qrels = qrels if own else search.others(qrels)
    want = sorted(map(tuple, metrics.per_query(run, qrels, (1, 3), universe).collect()))
    assert sorted(map(tuple, metrics.per_labelled_query(run, q, p, (1, 3), universe, own).collect())) == want and want


@pytest.mark.parametrize("name", ["q_ndcg", "q_mrr", "q_recall", "q_metrics_of_run", "q_metrics_dense_vs_vq"])
def test_registered_metrics_join_no_pairs_of_a_label(spark, monkeypatch, name):
    from codevane.plans import fixtures, registry

    def pairs(t):
        raise AssertionError("judged pairs are made")

    monkeypatch.setattr(fixtures.Tables, "qrels", property(pairs))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_digests_of_many_texts():
    import hashlib

    from codevane.functions.digests import Tails, leads

    for start, width in (("42|7|", 3), ("42|1234|", 2), ("s" * 52, 3), ("s" * 53, 3), ("", 4)):
        texts = [str(10 ** (width - 1) + i).encode() for i in range(30)]
        want = [hashlib.md5(start.encode() + x).hexdigest()[:8] for x in texts]
        assert [f"{x:08x}" for x in leads(start.encode(), Tails(texts))] == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_drawing_by_label_equals_drawing_from_pairs(spark, monkeypatch, kind):
    labels = [(i * 7, [1, 2, 3, None, 1, 2][i % 6]) for i in range(70)] + [(500, 9), (501, 1)]
    p = spark.createDataFrame(labels, "pid long, label int").withColumn("pid", F.col("pid").cast(kind))
    q = p.where("pid in (0, 14, 21, 70, 500)").withColumnRenamed("pid", "qid")
    pairs = search.others(q.select("qid", F.col("label").alias("own")).crossJoin(p)).where("own is not null and label is not null")
    pairs = pairs.select("qid", "pid", F.when(F.col("own") == F.col("label"), "pos").otherwise("neg").alias("role"))
    want = sorted(map(tuple, prep.drawn_pairs(pairs, 3).collect()))
    for name, n in (("QUERY_BLOCK", 2), ("PART_ROWS", 20)):
        monkeypatch.setattr(search, name, n)
    got = prep.drawn_by_label(q, p, 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 15
    assert "Join" not in plan(got)


def test_in_batch_loss_equals_that_of_pairs(spark, monkeypatch):
    q = some_terms(spark, 9, int).where("pid <> 4").withColumnRenamed("pid", "qid")
    p = some_terms(spark, 14, int, seed=9)
    s = {(r.qid, r.pid): r.score for r in search.sparse_scores(q, p).collect()}
    scores = spark.createDataFrame([(i, j, s.get((i, j), 0.0)) for i in range(9) for j in [*range(1, 14), 99]], "i long, j long, score double")
    want = sparse.contrastive(scores).first().loss
    for name, n in (("QUERY_BLOCK", 2), ("PART_ROWS", 5), ("SEARCH_ROWS", 3)):
        monkeypatch.setattr(search, name, n)
    none = spark.createDataFrame([(4, [])], "qid long, terms array<struct<code:int,weight:double>>")
    some = search.packed(p.where("pid > 0"), "pid").unionByName(none.select(F.lit(99).cast("long").alias("pid"), "terms"))
    got = sparse.in_batch(search.packed(q, "qid").unionByName(none), some)
    assert abs(got.first().loss - want) < 1e-9
    assert "Join" not in plan(got)


def some_texts(spark):
    texts = [(1, "a b  b c"), (2, "c\tc c "), (3, None), (4, " "), (5, "a x"), (1, "b d"), (6, "x y"), (None, "a"), (None, "b b"), (7, "b a a a b")]
    return spark.createDataFrame(texts, "pid long, text string"), spark.createDataFrame([(0, "a", 2.0), (0, "c", 1.0), (1, "b", 1.0), (2, "z", 1.0)], "qid long, code string, weight double")


@pytest.mark.parametrize("sent", [2, 1 << 20])
def test_bags_put_rows_of_a_text_together(spark, monkeypatch, sent):
    texts, words = some_texts(spark)
    monkeypatch.setattr(index, "SENT_WORDS", sent)
    found = index.bags(texts, "pid", words)
    got = {r.pid: (r.length, {t.code: t.weight for t in r.terms if t.code in "abcz"}) for r in found.collect()}
    assert got == {1: (6.0, {"a": 1, "b": 3, "c": 1}), 2: (2.0, {"c": 1}), 5: (2.0, {"a": 1}), 6: (2.0, {}), None: (3.0, {"a": 1, "b": 2}), 7: (5.0, {"a": 3, "b": 2})}
    assert "Join" not in plan(search.packed_search(search.packed(words, "qid"), index.bags(texts.where("pid in (2, 5)"), "pid", words).withColumn("free", F.lit(False))))


def test_bm25_of_bags_equals_bm25_of_terms(spark):
    texts, words = some_texts(spark)
    split = texts.select("pid", F.explode(F.split("text", " ")).alias("code")).where("code <> ''")
    scores = search.sparse_scores(words, index.bm25(index.term_frequency(split, "pid").where("pid is not null"), "pid"))
    want = search.ranked(scores.withColumn("score", F.round("score", 6)), 3).collect()
    found, idf = index.bm25_bags(index.bags(texts.where("pid is not null"), "pid", words))
    q = words.join(idf, "code").select("qid", "code", (F.col("weight") * F.col("idf")).alias("weight"))
    got = search.packed_search(search.packed(q, "qid"), found.withColumn("free", F.lit(False)), 3, digits=6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5


@pytest.mark.parametrize("name", ["q_contrastive", "q_total_loss"])
def test_registered_losses_make_no_pairs(spark, monkeypatch, name):
    from codevane.plans import registry

    def pairs(*args):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(search, "sparse_scores", pairs)
    monkeypatch.setattr(sparse, "contrastive", pairs)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 1
