"""The operators on Spark: edge cases, brute force, and results that do not depend on partitions."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curvelake.llm import common, crf, hamming, hmm, jaccard, merge_dropout, mixing, quality_rules, queries, sharding, token_counts, toxicity

from ..conftest import DATA
from .test_pure import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, v string, rid long, label int, mix_copy int"
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (None, "an absent id"), (None, None), (4, "short"), (5, "the same words here again and again " * 40), (5, "the same words here again and again " * 40),
    (6, "tie one two three four five six"), (7, "tie one two three four five six"), (8, "ünïcödé ▁ <s> 日本語　x"), (9, "long " * 30_000),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s", 0, 0.5, "w", "v", 7, 1, 3) for i, t in EDGE], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, (i or 0) % 2, (i or 1) % 2) for i, _ in EDGE if i != 5] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def run_all(docs, labels):
    tox, field = toxicity.train(docs, labels), crf.train(docs, labels)
    return {
        "op1": toxicity.classify(docs, tox), "op2": quality_rules.rules(docs), "op3": hmm.score(docs), "op4": token_counts.token_counts(docs), "op5": crf.classify(docs, field),
        "op6": sharding.shards(docs, n_shards=3), "op8": jaccard.join(docs), "op10": merge_dropout.encode(docs),
    }


def test_edge_cases_keep_every_row(edge, labels):
    for name, df in run_all(edge, labels).items():
        got = df.collect()
        assert len(got) == len(EDGE), name
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in EDGE), name
    assert mixing.mix(edge, weights={"s": 1.0}, total=3.0).where("source IS NULL").count() == 0
    assert mixing.mix(edge).columns == [*edge.columns, "_mix_copy", "mix_key"]


def test_empty_tables(none, labels):
    for name, df in run_all(none, labels.limit(0)).items():
        assert df.count() == 0, name
    assert mixing.mix(none).count() == 0


def test_token_columns_on_edges(edge):
    got = {r["doc_id"]: r for r in token_counts.token_counts(edge).collect() if r["doc_id"] is not None}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[2]["n_tokens"]) == (0, 0, 0)
    assert got[9]["over_limit"] and not got[4]["over_limit"]
    enc = merge_dropout.encode(edge, dropout=0.3)
    assert enc.where("NOT lossless").count() == 0
    back = {r["doc_id"]: r["text"] for r in merge_dropout.decode(enc).collect()}
    assert all(back[i] == (t or "") for i, t in EDGE if i is not None)


def test_copies_and_absent_ids_are_encoded_apart(spark):
    t = "several words that are merged from their letters " * 20
    mixed = spark.createDataFrame([(1, t)] * 6 + [(None, t + str(k)) for k in range(3)], "doc_id long, text string").repartition(4)
    got = [tuple(r["ids"]) for r in corpus_pipeline.encode(spark, mixed, DATA).collect()]
    assert len(set(got)) == 9
    one = spark.createDataFrame([(1, t, "s")] * 1, "doc_id long, text string, source string")
    assert corpus_pipeline.mix_sources(spark, one, DATA).columns == ["doc_id", "text", "source"]


def test_lm_with_rare_words(spark):
    docs = common.read(spark, DATA, "documents")
    got = {r["doc_id"]: r for r in hmm.score(docs, head=3000, own=500, shared=50, rounds=1).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(hmm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    import math

    for i, t in rows:
        ts = hmm.tokens(t)
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        assert abs(got[i]["base_score"] - want) < 1e-6 * max(1, abs(want))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ts), sum(counts[w] > 0 for w in ts), n)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_lm_states_come_from_whole_documents(spark):
    """Every round reads each training text to its end: the model is the one of rounds over all sequences here."""
    texts = [" ".join(["a b"] * 400 + [w] * 900) for w in ("c d e", "f g h")] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in hmm.score(docs, own=20, shared=5, rounds=3).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in train for w in hmm.tokens(t))
    top = sorted(counts, key=lambda w: (-counts[w], w))
    totals = np.zeros(25)
    totals[: len(top)] = [counts[w] for w in top]
    place = {w: i for i, w in enumerate(top)}
    seqs = [np.array([place[w] for w in hmm.tokens(t)]) for t in texts]
    totals = hmm.class_mass(totals, 20)
    model = hmm.first_model(totals, hmm.STATES)
    for _ in range(3):
        e = hmm.Expected(25, hmm.STATES)
        e.add(model, [s for i, s in enumerate(seqs) if zlib.crc32(str(i).encode()) % 5 != 1])
        model = e.model(totals)
    for i, want in enumerate(hmm.forward(model, seqs)):
        assert abs(got[i]["score"] - want) < 1e-6 * abs(want)


def test_shards_are_those_of_the_permutation(spark):
    docs = common.read(spark, DATA, "documents")
    got = sharding.shards(docs).collect()
    ids = sorted(r["doc_id"] for r in got)
    by = {r["doc_id"]: r for r in got}
    for row, i in enumerate(ids):
        p = sharding.permute(row, len(ids), 20)
        assert (by[i]["shard"], by[i]["slot"]) == (p % 24, p // 24)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(by[i]["size"] == len(t.encode()) + 8 and by[i]["text_crc32"] == zlib.crc32(t.encode()) for i, t in text.items())


def test_mixture_means(spark):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = {r["source"]: r["n"] for r in mixing.mix(docs, weights={"a": 0.9, "b": 0.1}, total=2.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 7200) < 400 and abs(got["b"] - 800) < 150
    high = mixing.mix(docs.where("doc_id < 20"), weights={"a": 1.0}, total=100.0).groupBy("doc_id").count().collect()
    assert abs(sum(r["count"] for r in high) - 2000) < 250  # a mean of 400 a row, drawn in parts
    again = mixing.mix(docs.repartition(7), weights={"a": 0.9, "b": 0.1}, total=2.0)
    assert {(r["doc_id"], r["mix_copy"]) for r in again.collect()} == {(r["doc_id"], r["mix_copy"]) for r in mixing.mix(docs, weights={"a": 0.9, "b": 0.1}, total=2.0).collect()}


def test_mixture_with_many_sources_is_the_same(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 30).cast("string").alias("source"))
    few = {(r["doc_id"], r["mix_copy"]) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    assert few == {(r["doc_id"], r["mix_copy"]) for r in mixing.mix(docs).collect()}


def corpus(seed):
    """Near copies, a common passage, exact copies and short texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    docs = []
    for i in range(60):
        t = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4))):
            t[rnd.randrange(len(t))] = word()
        docs.append(t)
    for i in range(60):
        docs.append([word() for _ in range(rnd.randint(5, 60))] + passage + [word() for _ in range(rnd.randint(0, 60))])
    chain = [word() for _ in range(200)]
    for i in range(25):
        chain = list(chain)
        for k in range(2):
            chain[(17 * i + 90 * k) % 200] = word()
        docs.append(chain)
    for i in range(60):
        docs.append([rnd.choice("abc") for _ in range(rnd.randint(0, 12))])
    rnd.shuffle(docs)
    return [(i, " ".join(t)) for i, t in enumerate(docs)] + [(1000, None), (1001, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.join(df).collect()}
    comp, size = brute_components(rows)
    assert got == {i: (comp[i], size[i]) for i in comp}


def test_components_with_hot_keys_by_brute_force(spark):
    """``meet`` and ``_rest`` with every group of three counted as large."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    j = jaccard.Join(df, "doc_id", "text", 5, 80)
    j.big = 2
    got = {r["doc_id"]: r["component_id"] for r in j.run().collect()}
    assert got == brute_components(rows)[0]


def test_components_where_short_ids_collide(spark, monkeypatch):
    """Similar classes of one short id never meet in a key; they are tried all the same."""
    monkeypatch.setattr(jaccard, "short_id", lambda key: key[0] % 4)
    rows = corpus(4)[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    j = jaccard.Join(df, "doc_id", "text", 5, 80)
    classes = {i: jaccard.class_key(jaccard.shingle_set(t)) for i, t in rows}
    j.classes = spark.createDataFrame([(bytearray(k), k[0] % 4, i, 1) for i, k in classes.items()], "ckey binary, who long, rep long, n long").dropDuplicates(["ckey"])
    empty = spark.createDataFrame([], "block int, kind int, data binary")
    lost = spark.createDataFrame([], "side long, lost long, need long")
    pairs = {tuple(r) for r in j._candidates(empty, lost, 4).collect()}
    assert pairs == {(w, w, 0) for w in range(4)}


def test_nearest_with_absent_and_repeated_rows(spark):
    rows = [(1, [1.0, -1.0, 1.0]), (2, [1.0, -1.0, 1.0]), (2, [1.0, -1.0, 1.0]), (3, [-1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in hamming.top_k(df, df.where("vec_id = 1"), k=2).orderBy("rank").collect()]
    assert got == [(1, 1, 1, 0), (1, 2, 2, 0)]
    assert hamming.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = common.read(spark, DATA, "documents")
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, kept, DATA)
        if name == "toxicity":
            model = toxicity.train(docs, common.read(spark, DATA, "labels"))
            rows = kept.select("doc_id", "text").collect()
            want = {r["doc_id"] for r, s in zip(rows, model.scores([r["text"] for r in rows]), strict=True) if s < 0.5}
        elif name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.rules(kept).where("kept").collect()}
        elif name == "jaccard_join":
            comp, _ = brute_components([(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()])
            want = set(comp.values())
        else:
            want = None
        if want is not None:
            assert ids(new) == want, name
        if name != "sentencepiece":
            assert new.columns == docs.columns
        kept = common.Scratch(spark, "test").cut(new)
    assert kept.columns == ["doc_id", "ids", "n_tokens", "lossless"]


def test_one_of_each_component_with_absent_and_repeated_ids(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(80)) for _ in range(8)]
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(None, texts[0]), (None, texts[1]), (None, near(texts[0])), (None, texts[1].upper()), (5, texts[2]), (5, texts[3]), (5, texts[2]), (5, texts[4]), (6, near(texts[4]))]
    rows += [(None, texts[5]), (9, near(texts[5])), (3, texts[6]), (4, near(texts[6])), (10, texts[7]), (11, ""), (11, " "), (None, None)]
    comp, size = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    seen = []
    for n in (1, 5):
        rnd.shuffle(order := list(range(len(rows))))
        df = spark.createDataFrame([(*rows[k], "s") for k in order], "doc_id long, text string, source string").repartition(n)
        out = corpus_pipeline.one_of_each_group(spark, df, DATA)
        assert out.columns == df.columns
        seen.append(collections.Counter((r["doc_id"], r["text"]) for r in out.collect()))
    assert seen[0] == seen[1]
    found = [rows.index(r) for r in seen[0].elements()]
    assert sorted(comp[k] for k in found) == sorted(set(comp.values()))
    for k in found:
        ids = [i for j, (i, _) in enumerate(rows) if comp[j] == comp[k] and i is not None]
        assert rows[k][0] == min(ids, default=None)


def test_rows_alike_draw_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 300)
    rows = [(1, "a", "s", 1)] * 2000 + [(2, "b", "t", 1), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, number int").repartition(5)
    got = common.numbered(df, "k")
    assert collections.Counter((r["doc_id"], r["k"]) for r in got.collect()) == collections.Counter([(1, k) for k in range(2000)] + [(2, 0), (None, 0), (None, 1)])
    for seed in range(3):
        mixed = mixing.mix(df.where("doc_id = 1"), seed=seed)
        n, keys = mixed.count(), mixed.select("mix_key").distinct().count()
        assert 1800 < n < 2200 and keys == n
        assert mixed.columns == [*df.columns, "mix_copy", "mix_key"]


def test_pipeline_takes_odd_rows(spark):
    """Each stage on absent, repeated, empty and long texts, on columns whose names it uses itself, and on an empty table."""
    rnd = random.Random(9)
    fine = common.read(spark, DATA, "documents").where("length(text) between 300 and 900").limit(12).collect()
    texts = [r["text"] for r in fine]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[3]), (None, texts[5]), (None, None), (50, None), (51, ""), (52, " ".join(f"w{rnd.randrange(9000)}" for _ in range(60000)))]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copy string, mix_key int")
    for start in (df, df.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            new = common.Scratch(spark, "test").cut(stage(spark, kept, DATA))
            if name != "sentencepiece":
                assert new.columns == df.columns and new.dtypes == df.dtypes
                assert {tuple(r) for r in new.collect()} <= {tuple(r) for r in kept.collect()}, name
            else:
                texts_of = collections.defaultdict(list)
                for r in kept.collect():
                    texts_of[r["doc_id"]].append(r["text"])
                back = collections.defaultdict(list)
                for r in merge_dropout.decode(new).collect():
                    back[r["doc_id"]].append(r["text"])
                assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in texts_of.items()}
                assert new.where("NOT lossless").isEmpty()
            kept = new
        if start is df:
            assert kept.count() > 0


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
