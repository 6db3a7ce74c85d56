"""The quality classifier on held-out labels, and what co-training adds."""

import random

from pyspark.sql import functions as F
from test_operators import prose

from feedloom.llm import common
from feedloom.llm import op08_quality as op8


def test_cotraining_learns_sources(spark):
    """Labels tell of half of the sources, which say little; the others' are learnt from clear texts, and settle unclear ones."""
    rows, truth = [], {}
    for i in range(2400):
        r, source = random.Random(i), i % 12
        bad = r.random() < ((0.8 if source % 2 == 0 else 0.2) if source < 6 else (0.98 if source % 2 == 0 else 0.02))
        rate = 0.05 if r.random() < 0.4 else 0.5 * bad
        words = [w + "***" if r.random() < rate else w for w in prose(i, 60).split()]
        rows.append((i, " ".join(words), "en", f"s{source}", None))
        truth[i] = int(not bad)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 12 < 6], "doc_id long, quality int")

    def wrong(rounds):
        got = op8.classify(docs, op8.train(docs, labels, rounds=rounds)).where("doc_id % 12 >= 6").select("doc_id", "_score").collect()
        return sum((r["_score"] >= 0.5) != truth[r["doc_id"]] for r in got)

    before, after = wrong(0), wrong(3)
    assert after < 0.9 * before, (before, after)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.read(spark, d, "documents"), common.read(spark, d, "labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    model = op8.train(docs, labels.where(half == 0))
    got = op8.classify(docs, model).join(labels.where(half == 1).select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.avg(F.col("_keep").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[0] <= 0.1 and kept[1] >= 0.98, kept


def test_ties_and_few_labels(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    out = op8.classify(docs, op8.train(docs, labels))
    assert out.count() == 4 and len({r["_score"] for r in out.where("doc_id = 1").collect()}) == 1
