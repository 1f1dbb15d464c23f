"""The pipeline against its operators' own brute-force rules on a small corpus."""

import numpy as np

import corpus_pipeline
from folioscope.llm import decontaminate, mixing, simhash, toxicity
from folioscope.llm.common import load
from tests.conftest import SF


def test_stages_take_effect(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    model = toxicity.train(docs, load(spark, SF, "labels"))
    rows = docs.toPandas()
    clean = rows[[toxicity.bag_result(model, t)[0] < toxicity.THRESHOLD for t in rows.text]]
    fps = np.array([simhash.fingerprint(t) for t in clean.text], np.uint64)
    group = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2):
            group[group == max(group[i], group[j])] = min(group[i], group[j])
    one = clean.assign(g=group).sort_values("doc_id").groupby("g").first()
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in load(spark, SF, "benchmark").collect()])
    left = one[[not items.matches(t) for t in one.text]]

    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        now = stage(spark, now, SF)
        assert now.columns == columns, name
    assert sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(left.doc_id)

    sized = spark.createDataFrame(left[["doc_id", "source"]].assign(size=[len(t.encode().split()) for t in left.text], h=0, uid=range(len(left))))
    copies = {r.doc_id: r.copies for r in mixing.sample_counts(sized).collect()}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.doc_id.value_counts().to_dict() == {d: c for d, c in copies.items() if c}
    n = out.groupby("shard").size()
    assert n.max() - n.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        load(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()
