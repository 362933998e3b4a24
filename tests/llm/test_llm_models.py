"""Language profiles and quality trees: accuracy on rows that taught nothing, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanemesh.llm import langid, quality

DOCS = "doc_id long, text string, lang string, source string, score double, label int"


@pytest.fixture(scope="module")
def taught(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"the cat and the dog number {i} with the other thing that is there", "en", "s", 0.5, 1))
        rows.append((100 + i, f"der hund und die katze nummer {i} mit dem anderen ding das nicht da ist", "de", "s", 0.5, 1))
    rows += [(200, None, "en", "s", 0.5, 1), (201, "ohne sprache", None, None, 0.5, 1)]
    return langid.learn(spark.createDataFrame(rows, DOCS))


def test_languages_are_told_apart(spark, taught):
    rows = [(1, "The dog with the thing", "x"), (2, "Die Katze mit dem Ding", "x"), (3, None, "x"), (4, "", "x"), (5, "12 34 !!", "x"), (None, "THE " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, taught).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0.0
    assert langid.predict(docs.limit(0), taught).count() == 0


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], DOCS)
    assert langid.learn(empty) == {}
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert langid.predict(docs, {}).first().lang_pred == "und"


def test_prototypes_do_not_hang_on_partitions(spark, taught):
    rows = [(i, f"word{i} here and there", "en", "s", 0.0, 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    one, other = langid.learn(docs.repartition(1)), langid.learn(docs.repartition(5))
    assert np.array_equal(one["en"], other["en"])


def test_trigrams_of_long_texts_in_chunks(monkeypatch):
    text = "Ein langer Text, mit Ümlauten! " * 40
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    parts = langid.trigrams(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    prototypes = langid.learn(docs.where(~held))
    right = langid.predict(docs.where(held).select("lang", "text"), prototypes).where("lang is not null")
    n, good = right.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert good / n > 0.97


def test_trees_learn_a_rule_that_is_not_linear():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    assert ((p >= 0.5) == (y[2000:] == 1)).mean() > 0.95
    # The arrays walk as the nodes do, one row at a time.
    for row in x[2000:2020]:
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(1 / (1 + np.exp(-total)) - trees.score(row[None])[0]) < 1e-9


def test_trees_without_rows_or_with_one_class(spark):
    none = quality.fit(np.empty((0, len(quality.STATISTICS))), np.empty(0))
    assert none.score(np.zeros((2, len(quality.STATISTICS)))).tolist() == [0.5, 0.5]
    one = quality.fit(np.zeros((50, len(quality.STATISTICS))), np.ones(50))
    assert one.score(np.zeros((1, len(quality.STATISTICS))))[0] > 0.9
    docs = spark.createDataFrame([(1, "a", 3)], "doc_id long, text string, score_ int")
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert quality.score(docs, quality.teach(docs, labels)).first().score == 0.5


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n\n", "word", "x" * 200_000, "퟿\U0001f600 ́", "a\x00b", "### $$$ %%%"):
        row = quality.statistics(text)
        assert len(row) == len(quality.STATISTICS) and np.isfinite(row).all()


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    trees = quality.teach(docs, labels.where(~held))
    judged = quality.score(docs.select("doc_id", "text"), trees).join(labels.where(held), "doc_id").collect()
    assert sum((r.score >= quality.THRESHOLD) == (r.label == 1) for r in judged) / len(judged) > 0.95
    good = quality.select_good(docs, trees)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    assert quality.select_good(docs.limit(0), trees).count() == 0


def test_repeated_labels_and_rows_teach_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(20)] + [(None, "x"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 5, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, label int")
    assert 0 < quality.score(docs, quality.teach(docs, labels, sample=4)).first().score < 1


def test_trees_are_taught_next_to_columns_of_any_name(spark):
    from vanemesh.llm import quality

    docs = spark.createDataFrame([(i, "Good words stand here. " * 9 if i % 2 else "!! $$ " * 30) for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 AS label")
    plain = quality.teach(docs, labels)
    clashing = quality.teach(docs.selectExpr("*", "7 AS label", "8 AS _hash", "9 AS _id"), labels.selectExpr("*", "1 AS text"))
    assert (plain.threshold == clashing.threshold).all() and (plain.value == clashing.value).all() and len(plain.roots)
