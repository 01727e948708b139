import corpus_pipeline as pipe
from tidemark.llm import decontaminate, secret_scan, simhash, toxicity
from tidemark.llm.common import stored
from tests.llm.test_text import fingerprint


def test_stages(spark, sf, documents):
    docs, kept = documents, {}
    for name, stage in pipe.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), f"test-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns
        if name == "near_duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(groups.values()))
            prints = [fingerprint(r["text"]) for r in docs.collect()]
            assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate.digest(docs, bench).where("contaminated").count() == 0
            assert before.count() - docs.count() == decontaminate.digest(before, bench).where("contaminated").count()
        if name == "secrets":
            assert docs.count() == before.count() and not [s for r in docs.collect() for s in secret_scan.base_spans(r["text"] or "")]
    net = toxicity.train_on(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(documents, net).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in kept["toxicity"].collect()} == {r["doc_id"] for r in documents.collect()} - toxic
    assert {r["doc_id"] for r in kept["packing"].collect()} == {r["doc_id"] for r in kept["secrets"].collect()}


def test_it_is_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] if k.startswith("op") else k for k in entry.queries()}
