"""Language ID and the quality classifier: held-out accuracy, defined results at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import langid, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_codewords_part_all_languages():
    for n in (2, 3, 4, 5, 9, 20):
        words = langid.codebook(n)
        far = (words[:, None] != words[None]).sum(2) + np.eye(n, dtype=int) * 99
        assert far.min() >= (1 if n == 2 else 2) and words.shape[0] == n


def test_language_held_out_accuracy(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and len(got) == docs.count()


def test_decoding_corrects_a_wrong_bit_and_flags_doubt():
    words = langid.codebook(4)
    model = langid.Model(list("abcd"), words, np.zeros((1, 7)), np.ones(7))
    margins = words.astype(float).copy()
    margins[2, 0] *= -1
    which, score, lead = langid.decode(model, margins)
    assert which.tolist() == [0, 1, 2, 3] and score[2] < score[1]
    _, _, lead = langid.decode(model, (words[0:1] + words[1:2]) / 2.0)
    assert lead[0] < 0.2


def test_language_edges(spark, docs):
    model = langid.fit(docs.limit(300))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "Thion the and of erning " * 20_000), (4, "été"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = {(r.doc_id, (r.text or "")[:3]): r for r in langid.predict(df, model).collect()}
    assert [got[k, t].lang_pred for k, t in ((1, ""), (2, ""), (3, "123"))] == ["und"] * 3
    assert got[4, "Thi"].lang_pred == "en" and len(got) == 6 and 0 <= got[4, "été"].score <= 1
    assert langid.identify(docs.limit(0)).count() == 0
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs.limit(5), none).collect()} == {"und"}


def test_no_letter_is_und(spark, docs):
    model = langid.fit(docs.limit(300))
    bare = ["½", "²", "①", "\u0301\u0308", "٣", "_ª"[:1], "Ⅷ"]  # numbers, marks, digits, an underscore
    df = spark.createDataFrame(list(enumerate([*bare, "ª", "ж"])), "doc_id long, text string")
    got = {r.text: r.lang_pred for r in langid.predict(df, model).collect()}
    assert {got[t] for t in bare} == {"und"} and "und" not in (got["ª"], got["ж"])  # ª is category Lo


def test_quality_held_out_accuracy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.quality == held.predicted).mean() > 0.9
    assert held[held.quality == 1].score.mean() > held[held.quality == 0].score.mean() + 0.4
    ranks, yes = held.score.rank(), held.quality == 1
    assert (ranks[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum()) > 0.9  # area under the curve
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_is_a_function_of_the_difference(spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in docs.where("length(text) > 0").limit(60).collect()]
    far = np.array([quality.difference(t, model.good, model.bad) for t in texts])
    score = np.array([model.score(t) for t in texts])
    by = np.argsort(far)
    assert (np.diff(score[by]) >= 0).all() and score.max() > score.min()


def test_quality_sample_is_bounded(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.fit(docs, labels, most_bytes=10).good == b""
    model = quality.fit(docs, labels, per_class=60, most_bytes=100_000)
    assert 0 < len(model.good) <= 100_000 and 0 < len(model.bad) <= 100_000


def test_quality_edges(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.classify(docs.limit(0), labels).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        got = quality.classify(docs.limit(20), some).toPandas()
        assert len(got) == 20 and got.score.between(0, 1).all()
    twice = labels.unionByName(labels).unionByName(labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("quality"), "toxic").limit(3))
    model = quality.fit(docs, twice)
    rows = [(1, None, 1), (2, "", 2), (3, "z" * 200_000, 3), (3, "z" * 200_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q_score int")
    got = quality.score(df, model).collect()
    assert len(got) == 4 and got[2].score == got[3].score and got[0].score == got[1].score == model.prior
    assert quality.keep_good(df, twice.limit(0)).columns == df.columns
