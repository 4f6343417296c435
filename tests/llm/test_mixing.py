import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tests.llm.conftest import ODD_PAIRS, spaced_words
from veilframe.llm.mixing import mix_sources


def level_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Targets by sharing again and again what sources cannot take, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, Fraction(0)), set(order)
    left = Fraction(sum(sizes.values()) * percent, 100)
    while left and open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + share * weight[s] > most * sizes[s]}
        for s in open_ - over:
            target[s] += share * weight[s]
        left = Fraction(0)
        for s in over:
            left += target[s] + share * weight[s] - most * sizes[s]
            target[s] = Fraction(most * sizes[s])
        open_ -= over
    return target


def check(rows, texts, evenness=0.5):
    """``texts``: (key, text, source) triples; all promises of the docstring but the nearness of the sums."""
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter((k, len(spaced_words(t)), s) for k, t, s in texts)
    sizes = Counter()
    for _, text, source in texts:
        sizes[source] += len(spaced_words(text))
    targets = level_targets(sizes)
    given = defaultdict(float)
    multipliers = defaultdict(set)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(targets[r["source"]]), abs=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        given[r["source"]] += r["rate"] * r["size"]
        if r["size"] and r["rate"] < 2:
            if r["rate"] > 1e-3:  # rates have nine places
                multipliers[r["source"]].add(math.log(r["rate"]) / r["size"] ** (1 - evenness))
    for source, words in given.items():
        assert words == pytest.approx(float(targets[source]), rel=1e-6, abs=1e-3)  # the constraints of the dual hold
        assert max(multipliers[source], default=0) - min(multipliers[source], default=0) < 1e-5  # one tilt for each source
    return sizes, targets


def test_documents(documents):
    texts = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    rows = mix_sources(documents).collect()
    _, targets = check(rows, texts)
    taken, smallest = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        smallest[r["source"]] = min(smallest.get(r["source"], 10**9), r["size"])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(smallest[source], 0.01 * target)
    again = mix_sources(documents.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_hot_source_hot_key_and_null(spark):
    schema = "doc_id long, text string, source string, size string, copies string, _key string"
    texts = [(1, "one two three", "hot")] * 500 + [(k, "w " * (k % 40), None if k % 3 else "b") for k in range(2, 600)]
    df = spark.createDataFrame([(*t, "x", "x", "x") for t in texts], schema).repartition(6)
    rows = mix_sources(df).collect()
    _, targets = check(rows, texts)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 3 for s, t in targets.items())
    even = mix_sources(df, evenness=1.0).collect()
    assert all(len({round(r["rate"], 9) for r in even if r["source"] == s}) == 1 for s in targets)


def test_odd_rows(odd, nothing):
    texts = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert len(texts) == len(ODD_PAIRS)
    check(mix_sources(odd).collect(), texts)
    assert mix_sources(nothing).collect() == []
    wordless = mix_sources(odd.where("doc_id in (1, 2, 3)")).collect()
    assert len(wordless) == 3 and all(r["target"] == 0 and r["taken"] == 0 for r in wordless)
