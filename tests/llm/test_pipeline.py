import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_decontam import brute_force as leaks
from tests.llm.test_near_dedup import brute_force as copies
from veilframe.llm import toxicity


def test_stages_as_brute_force(spark, small, documents, plain):
    """Each stage on all that the one before kept, against plain loops; the model of stage one is taken as it is."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "pii", "sentencepiece"]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(*toxicity.fit_sample(documents, labels, F.lit(True)))
    clean = {r["doc_id"] for r in toxicity.toxicity(documents, model).where("predicted = 0").collect()}
    assert len(clean) < len(plain)
    one = stages["toxicity"](spark, documents, small)
    assert one.schema == documents.schema and {r["doc_id"] for r in one.collect()} == clean

    groups = copies({k: plain[k] for k in clean})
    first = {k for k, (_, component) in groups.items() if component == k}
    two = stages["near_dedup"](spark, documents.where(F.col("doc_id").isin(*clean)), small)
    assert two.columns == documents.columns and {r["doc_id"] for r in two.collect()} == first

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaked = {k for k, _ in leaks([(k, plain[k]) for k in first], items)}
    three = stages["decontamination"](spark, documents.where(F.col("doc_id").isin(*first)), small)
    assert {r["doc_id"] for r in three.collect()} == first - leaked

    four = stages["pii"](spark, documents.where(F.col("doc_id").isin(*(first - leaked))), small)
    masked = {r["doc_id"]: r["text"] for r in four.collect()}
    assert four.columns == documents.columns and set(masked) == first - leaked

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    result = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(result) == set(masked)
    for k, text in masked.items():
        ids = library.encode(text)
        assert result[k]["n_tokens"] == len(ids)
        assert result[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_with_odd_rows(spark, small, odd, nothing):
    for table in (odd, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == table.columns, name
            docs = docs.persist()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 11 and "pipeline" in names
