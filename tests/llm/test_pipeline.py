import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n, columns = docs.count(), docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, d), "test")
        assert 0 < docs.count() <= n
        n = docs.count()
        assert docs.columns == columns + ["copies"] * (i == 4)


def test_stages_on_odd_rows_and_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    words = [f"{a}{b}" for a in ("lo", "ka", "mi", "ru", "te", "so", "na", "pe") for b in ("ten", "mur", "gal", "rin", "dos", "vek", "bal", "sum", "fir", "hot")]
    text = "\n".join(" ".join(words[i : i + 8]) for i in range(0, 80, 8))
    other = "\n".join(" ".join(reversed(words[i : i + 8])) for i in range(0, 80, 8))
    rows = [(1, text, "en", "src1"), (1, text, "en", "src1"), (2, text, None, None), (3, other, "en", "src2"), (None, other + "\n" + text, "en", None), (4, None, "en", "src1"), (5, "", None, "src1")]
    clashing = ["'x' as kept", "1 as doc", "2 as row_key", "3 as bitmap", "4 as n_words", "5 as c0", "6 as whole", "7 as root", "8 as upper_symbol_rate"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *clashing)
    for start in (docs, docs.limit(0)):
        now = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = corpus_pipeline.staged(stage(spark, now, d), "test")
            assert now.columns == docs.columns + ["copies"] * (i == 4)
            assert {r.kept for r in now.collect()} <= {"x"}
            if i == 0:
                assert sorted(r.doc_id or 0 for r in now.collect()) == ([0, 1, 1, 2, 3] if start is docs else [])
            if i == 2:
                assert sorted(r.doc_id or 0 for r in now.collect()) == ([1, 3] if start is docs else [])
