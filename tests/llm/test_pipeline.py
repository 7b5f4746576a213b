"""The pipeline against a brute-force version: the fitted models of each stage, applied document by document."""

import corpus_pipeline as pipeline
from conftest_llm import EDGES, frame
from pyspark.sql import functions as F
from test_near_copies import groups, similar, text_sets
from test_packing import check

from grainwise.llm import pii, quality, toxicity
from grainwise.llm.common import chance

SF = "/root/testdata/sf0.001"


def test_stages_and_run(llm):
    source = docs = llm.read.parquet(f"{SF}/documents.parquet")
    labels = llm.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in source.orderBy("doc_id").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        if name == "quality":
            model = quality.learn(docs, labels)
            measure = model.measure()
            rows = [r for r in rows if chance(model.beta, *measure(r["text"].encode())) >= 0.3]
        elif name == "toxicity":
            lexicon = toxicity.learn(docs, labels)
            table, own = toxicity.folding(), lexicon.automaton()
            rows = [r for r in rows if chance(lexicon.beta, *toxicity.features(toxicity.fold(r["text"], table), own)[:2]) < 0.5]
        elif name == "near_copies":
            sets = text_sets([r["text"] for r in rows], 5)
            roots = groups(len(rows), lambda a, b: similar(sets[a], sets[b]))
            rows = [r for i, r in enumerate(rows) if roots[i] == i]
        else:
            model = pii.learn(docs)
            rows = [r | {"text": (t := pii.redact(r["text"], pii.spans(r["text"], model)[1])), "n_chars": len(t)} for r in rows]
        docs = pipeline.stored(stage(llm, docs, SF), "test")
        assert docs.columns == source.columns and dict(docs.dtypes) == dict(source.dtypes)
        assert sorted(map(str, (r.asDict() for r in docs.collect()))) == sorted(map(str, rows)), name
    check(docs, pipeline.run(llm, SF).drop("ids"))


def test_stages_on_edges(llm):
    docs = frame(llm, [*EDGES, "mail a.b@c.example.com now"]).withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1).cast("bigint"))
    docs = docs.union(docs.filter("doc_id = 12")).union(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint")))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(llm, docs, SF)
        assert out.columns == list(pipeline.COLUMNS)
        assert out.count() <= docs.count()
        assert stage(llm, docs.limit(0), SF).count() == 0
    kept = [r["doc_id"] for r in pipeline.one_of_each_group(llm, docs, SF).collect()]
    assert kept.count(12) == 1 and 13 not in kept and None in kept
    texts = {r["doc_id"]: r["text"] for r in pipeline.without_personal_data(llm, docs, SF).collect()}
    assert texts[14] == "mail [EMAIL] now" and texts[0] is None
    assert pipeline.packed(llm, docs.limit(0), SF).count() == 0
