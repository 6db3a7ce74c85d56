"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from feedloom.llm import common, op07_jaccard_join

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read(spark, D, "documents")
    columns, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r["quality"] for r in common.read(spark, D, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        last = docs
        docs = common.cut(stage(spark, docs, D), "test")
        assert docs.columns == columns and docs.schema == last.schema
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality classifier":
            good = [i for i, q in labels.items() if q]
            assert sum(i in kept for i in good) >= 0.98 * len(good) and len(kept) < before
        elif name == "line dedup":
            assert docs.count() == last.count()
        elif name == "n-gram Jaccard join":
            groups = op07_jaccard_join.join(last).collect()
            assert kept == {r["component_id"] for r in groups}
        elif name == "benchmark decontamination":
            items = [" ".join(r["text"].lower().split()) for r in common.read(spark, D, "benchmark").collect()]
            held = {r["doc_id"] for r in last.collect() if any(i in " ".join(r["text"].lower().split()) for i in items)}
            assert not held & kept and len(kept) >= last.count() - len(held) - 3
    out = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert out.count() == docs.count()


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, an empty table: no stage fails, and each decision holds for rows without an id."""
    from test_operators import prose

    copy, dirty = prose(1, 60), prose(2, 60)
    bench, labels = spark.createDataFrame([(1, dirty[20:180])], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, copy, "en", "s", 5), (None, copy, None, None, None), (None, copy, None, None, None), (None, dirty, "en", "s", 1), (4, dirty, "en", None, None), (5, None, None, None, None), (5, "", "en", "s", 0), (6, prose(3, 60), "en", "s", 1), (6, prose(4, 60), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, want in ((docs, [(1, copy), (5, ""), (5, None), (6, prose(3, 60)), (6, prose(4, 60))]), (docs.limit(0), [])):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = common.cut(stage(spark, out, str(tmp_path)), "odd")
            assert out.schema == docs.schema
        key = lambda x: (x[0], x[1] or "", x[1] is None)
        assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=key) == sorted(want, key=key)
        assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == len(want)


def test_idle_workers_give_memory_back(spark):
    """A worker outlives its task; what the task has freed is the system's again, though pieces between are still in use."""

    def work(batches):
        import os
        import sys

        import pyarrow as pa

        for _ in batches:
            pieces = [bytes(4000) for _ in range(75_000)]
            sys.feedloom_kept = pieces[::500]
            del pieces
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()]})

    (row,) = common.arrow_map(spark.range(1, numPartitions=1), work, "pid long").collect()
    with open(f"/proc/{row['pid']}/smaps_rollup") as f:
        held = sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) / 1024
    assert held < 200
