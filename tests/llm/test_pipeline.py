import pytest

from .conftest import DOCS

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_stage_takes_effect(spark, rng, tmp_path):
    # One vocabulary for all texts, so that the item doesn't make its document unlike the rest.
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(18)
    clean = [prose(120) for _ in range(40)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(clean)]
    rows.append((100, clean[0] + " end", "en", "s0", 1))
    rows.append((101, f"{prose(60)} {item} {prose(60)}", "en", "s0", 1))
    rows.append((102, "too short", "en", "s0", 1))
    rows.append((103, f"{prose(60)} a@b.org {prose(60)}", "en", "s1", 1))
    rows.append((104, None, None, None, None))
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    from foliospark.llm import common

    docs, ids = common.table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "pii":
            assert "[EMAIL]" in docs.filter("doc_id = 103").first().text
    everything = set(range(40)) | {100, 101, 103}
    assert ids["quality"] == everything
    assert ids["near_dedup"] == everything - {100}
    assert ids["decontamination"] == ids["pii"] == ids["packing"] == everything - {100, 101}
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
