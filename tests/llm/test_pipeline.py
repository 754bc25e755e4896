"""The pipeline's stages on a small corpus, each against what it promises."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import text_of


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, text_of(rng.randint(30, 120), rng) + " the and of" + (" vileword" if i % 5 == 0 else ""), "en", f"s{i % 3}") for i in range(400)]
    rows += [(1000, rows[1][1], "en", "s1"), (1001, rows[2][1] + " more", "en", "s1"), (1002, "short", "en", "s0"), (1003, None, None, None), (1004, "# $ % " * 50, "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "simhash near-dedup", "mixing to target weights", "best-fit packing"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != names[-1]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at.collect()
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    assert not any(i % 5 == 0 for i in ids["toxicity"] if i < 400) and len(ids["toxicity"]) >= 320
    assert not {1002, 1003, 1004} & ids["quality rules"] and ids["quality rules"] >= {i for i in ids["toxicity"] if i < 400}
    assert ids["simhash near-dedup"] == ids["quality rules"] - {1000, 1001}
    assert ids["mixing to target weights"] <= ids["simhash near-dedup"]
    assert ids["best-fit packing"] == ids["mixing to target weights"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[names[-1]])
    more = {c: F.lit(7) for c in ("digest", "stay_digest", "stay_id", "stay_copies", "part", "rank", "place", "b_part", "measures", "size")}
    for name, stage in corpus_pipeline.STAGES[:3]:  # clashing names change nothing
        before = docs if name == names[0] else spark.read.parquet(str(tmp_path / names[names.index(name) - 1]))
        assert {r["doc_id"] for r in stage(spark, before.withColumns(more), str(tmp_path)).collect()} == ids[name]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
