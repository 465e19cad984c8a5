import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tests.llm.test_language import rows as prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    base = [(k, f"{t} {k}x{k} unique{k} " + " ".join(f"{lang}{k}q{i}" for i in range(9)), lang) for k, (_, t, lang) in enumerate(prose(15, 8))]
    item = " ".join(f"bench{i}" for i in range(20))
    extra = [(100, base[0][1] + " tail", "en"), (101, base[6][1].upper(), "en"), (102, "and the of to " + item, "en"),
             (103, None, "en"), (104, "12 34 !!", "de"), (105, "", None), (106, base[2][1], None), (2, base[2][1], "fr"), (None, base[3][1], "en")]
    rows = [(k, t, la, "src", len(t or "")) for k, t, la in base + extra]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "pack":
            assert at.columns == docs.columns
        kept.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in at.collect()))
    clean = list(range(len(base)))
    assert kept[0] == sorted([-1, 2, *clean, 100, 101, 102, 106])  # 103 to 105 have no letters
    assert kept[1] == sorted([*clean, 102])
    assert kept[2] == clean
    assert set(kept[3]) == set(clean)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(clean)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
