"""The pipeline's stages against plain Python, one by one on each stage's own input."""

from collections import Counter
from functools import partial

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from codevane.llm import language, pii, registry, similarity


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """Each stage's input, as Parquet."""
    path = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10**6, "12 34 !!", "en", "src0", 8), (10**6 + 1, None, "en", None, None), (10**6 + 2, "Жизнь прекрасна и удивительна каждый день " * 4, None, "src1", 1), (None, docs.first().text, "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(2))
    found = []
    for i, (_, stage) in enumerate(P.STAGES):
        found.append(docs)
        stage(spark, docs, sf).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
    return [*found, docs]


def test_stages_keep_the_columns(tables):
    assert len(P.STAGES) == 5
    assert all(tuple(t.columns) == P.COLUMNS for t in tables[:-1])


def test_language_stage(tables):
    had, kept = tables[0].count(), tables[1]
    gone = {r.doc_id for r in tables[0].join(kept.select("doc_id"), "doc_id", "left_anti").collect()} - {None}
    assert gone == {10**6, 10**6 + 1, 10**6 + 2} and kept.count() == had - 3
    assert kept.where(F.col("lang") == language.UNKNOWN).count() == 0


RARE = [(10**7 + i, f"Жизнь прекрасна и удивительна каждый день, {i} раз и снова " * 3, "ru", "src0", 1) for i in range(4)]


def test_a_rare_language_is_learned(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(RARE, docs.schema))
    monkeypatch.setattr(language, "fit", partial(language.fit, sample_rows=2))
    kept = P.identify(spark, docs, sf).where("doc_id >= 10000000").collect()
    assert sorted((r.doc_id, r.lang) for r in kept) == [(r[0], "ru") for r in RARE]


def test_a_label_that_was_not_learned_stays(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda d, **k: fit(d.where("lang <> 'ru'"), **k))
    kept = P.identify(spark, docs.unionByName(spark.createDataFrame([*RARE, (1, "12 !!", "ru", "src0", 1)], docs.schema)), sf)
    assert sorted(r.doc_id for r in kept.where("lang = 'ru'").collect()) == [r[0] for r in RARE]


CLASH = ("id", "class", "node", "token", "component_id", "key", "spans", "shard", "slot_key", "size", "taken", "lang_pred", "score", "ids", "n_tokens", "word", "bucket")


@pytest.mark.parametrize("i", range(5))
def test_stages_of_empty_tables_and_clashing_columns(spark, sf, tables, i):
    _, stage = P.STAGES[i]
    docs = tables[i].orderBy("doc_id").limit(60)
    clash = docs.withColumns({c: F.lit("clash") for c in CLASH})
    key = lambda r: str(tuple(r))
    want, got = stage(spark, docs, sf), stage(spark, clash, sf)
    assert want.columns == got.columns and sorted(map(key, want.collect())) == sorted(map(key, got.collect()))
    assert stage(spark, clash.where("false"), sf).collect() == []


@pytest.mark.parametrize("i", range(5))
def test_stages_of_nulls_and_repeats(spark, sf, tables, i):
    _, stage = P.STAGES[i]
    rows = [(None, None, None, None, None)] * 2 + [(5, "", "en", None, 0), (5, None, "en", "src0", None), (6, " \n", None, "src0", 1)] + [tuple(r) for r in tables[1].limit(3).collect()] * 2
    got = stage(spark, spark.createDataFrame(rows, tables[0].schema), sf).collect()
    n = {"language identification": 6, "near copies": 2 + 3 + 3, "personal data": 11, "mixing": None, "encoding": 11}[P.STAGES[i][0]]
    assert n is None or len(got) == n


def test_one_of_each_group_stays(tables):
    groups = similarity.join(tables[1], similarity.Rule(5, 80, 100)).where("doc_id is not null").collect()
    assert sorted(r.doc_id for r in tables[2].where("doc_id is not null").collect()) == sorted({r.component_id for r in groups})
    assert tables[2].where("doc_id is null").count() == tables[1].where("doc_id is null").count()


def test_texts_under_one_id_are_documents(spark):
    a, b = " ".join(f"red{i}" for i in range(60)), " ".join(f"blue{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (3, b), (4, "something else"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in P.unite(spark, docs, "").collect())
    assert kept == Counter([(1, a), (1, b), (4, "something else"), (None, a)])


def test_no_personal_data_is_left(tables):
    left = pii.digest(tables[3]).agg(*[F.sum(f"n_{k}").alias(k) for k in ("email", "ip", "card", "phone")]).first()
    assert sum(left) == 0 and tables[3].count() == tables[2].count()


def test_mix_repeats_whole_rows(tables):
    had = Counter(tuple(r) for r in tables[3].collect())
    assert all(n <= 2 * had[r] for r, n in Counter(tuple(r) for r in tables[4].collect()).items())


def test_ids(tables):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, r.source, tuple(t.encode(r.text or "", add_special_tokens=False).ids)) for r in tables[4].collect())
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in tables[5].collect()) == want


def test_run_is_the_chain_of_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda r: (r.doc_id, tuple(r.ids))
    assert sorted(map(key, P.run(spark, sf).collect())) == sorted(map(key, docs.collect()))


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
