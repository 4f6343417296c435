import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_PAIRS
from veilframe.llm import toxicity as tox
from veilframe.llm.common import NOT_ALNUM, words_of


def invented(seed, count=700):
    """Texts of invented words; those with label 1 hold one of a few words somewhere."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for k in range(count):
        words = [rng.choice(common) for _ in range(rng.randint(1, 120))]
        label = int(k % 4 == 0)
        if label:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "rotten"])
        texts.append(" ".join(words))
        labels.append(label)
    return texts, np.array(labels)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = tox.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors = rng.standard_normal((6, tox.WORD_SIZE + tox.CHAR_SIZE))
    places = rng.integers(0, 6, (7, 4))
    real = np.ones((7, 4), bool)
    real[5:, 1] = False
    target = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        z = net.logits(net.gates(vectors), places, real)
        return np.mean(np.logaddexp(0, z) - target * z)

    g, d_vectors = net.gradients(vectors, places, real, target)
    for name in ("input", "bias", "forward", "backward", "attend", "out", "shift"):
        flat = net.p[name].reshape(-1)
        for at in rng.integers(0, len(flat), 3):
            kept = flat[at]
            flat[at] = kept + 1e-3
            high = loss()
            flat[at] = kept - 1e-3
            low = loss()
            flat[at] = kept
            assert abs((high - low) / 2e-3 - np.asarray(g[name]).reshape(-1)[at]) < 1e-4, name
    vectors[2, 3] += 1e-3
    high = loss()
    vectors[2, 3] -= 2e-3
    assert abs((high - loss()) / 2e-3 - d_vectors[2, 3]) < 1e-4


def test_windows_cover_every_word():
    words = words_of(pa.array([None, "", "a", " ".join("abcdefghijklmnopqrstuvwxyz"), "x " * 1000]), NOT_ALNUM)
    starts, row = tox.windows(words)
    covered = {(r, w) for s, r in zip(starts, row, strict=True) for w in range(s, min(s + tox.WINDOW, words.rows[r + 1]))}
    assert {w for _, w in covered} == set(range(len(words.starts)))
    assert set(row) == {2, 3, 4}


def test_learns_and_holds_out(spark, table, odd, nothing):
    texts, labels = invented(1)
    docs = table(enumerate(texts))
    named = spark.createDataFrame([(k, int(y)) for k, y in enumerate(labels)] + [(10**6, None)], "doc_id bigint, toxic int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    sample = tox.fit_sample(docs, named, ~held_out)
    allowed = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sorted(sample[0]) == sorted(texts[k] for k in allowed)
    assert len(tox.fit_sample(docs, named, ~held_out, fit_rows=20)[0]) == 20
    model = tox.fit(*sample)
    rows = {r["doc_id"]: r for r in tox.toxicity(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    unseen = [k for k in range(len(texts)) if k not in set(allowed)]
    right = [rows[k]["predicted"] == labels[k] for k in unseen]
    assert np.mean(right) > 0.93
    # A toxic word deep in a long text is found, wherever the windows lie.
    clean = [t for t, y in zip(texts, labels, strict=True) if not y and len(t) > 200][0]
    deep = [" ".join([clean] * 20 + ["x"] * k + ["rotten"] + [clean] * 20) for k in range(0, 24, 5)]
    assert (model.scores(pa.array(deep)) >= tox.CUT).all()
    kept = tox.without_toxic(docs, model)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if not r["predicted"]}
    scored = tox.toxicity(odd, model).collect()
    assert len(scored) == len(ODD_PAIRS)
    assert {r["score"] for r in scored if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert tox.toxicity(nothing, model).count() == 0 and tox.without_toxic(nothing, model).count() == 0


def test_without_both_labels(table, spark):
    docs = table([(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")):
        model = tox.fit(*tox.fit_sample(docs, labels, F.lit(True)))
        assert [r["predicted"] for r in tox.toxicity(docs, model).collect()] == [0, 0]


def test_same_model_for_any_partitioning(documents, spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    one = tox.fit_sample(documents, labels, F.lit(True))
    two = tox.fit_sample(documents.repartition(5), labels.repartition(3), F.lit(True))
    assert one[0] == two[0] and (one[1] == two[1]).all()


def test_phrase_is_whole_in_some_window():
    """A phrase of 12 words lies in a window at every offset of the text."""
    words = words_of(pa.array([" ".join(["w"] * 100)]), NOT_ALNUM)
    starts, _ = tox.windows(words)
    for at in range(100 - 12 + 1):
        assert ((starts <= at) & (at + 12 <= starts + tox.WINDOW)).any(), at


def test_sample_of_repeated_and_long_documents(table, spark):
    """A labelled document that repeats comes once, and a long one comes whole."""
    long = " ".join(f"word{k}" for k in range(9000))
    pairs = [(1, "hot text here")] * 3000 + [(2, f"version {k} of a hot key") for k in range(300)] + [(3, long), (4, "cold text"), (5, "not labelled")]
    named = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id bigint, toxic int")
    texts, labels = tox.fit_sample(table(pairs).repartition(7), named, F.lit(True))
    assert len(texts) == len(labels) == 303 and len(set(texts)) == 303
    assert long in texts and labels[texts.index(long)] == 1
    assert len(tox.fit_sample(table(pairs).repartition(7), named, F.lit(True), fit_rows=50)[0]) == 50
