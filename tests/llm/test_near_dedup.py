from collections import Counter
from itertools import combinations

import numpy as np

from tests.llm.conftest import LONG, ODD_PAIRS, spaced_words
from veilframe.llm import near_dedup
from veilframe.llm.components import components
from veilframe.llm.near_dedup import near_duplicate_groups, one_of_each_group, super_minhash


def shingles(text):
    words = spaced_words(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_force(texts, percent=85):
    """Smallest reachable id and set size by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = Counter(p for ids in holders.values() for p in combinations(sorted(ids), 2))
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_documents_as_brute_force(documents, plain):
    assert result(near_duplicate_groups(documents)) == brute_force(plain)


def test_many_copies_far_from_each_other(table):
    """Most copies are too far from the text they come from; some pairs of them are linked nevertheless."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for family in range(60):
        words = list(base)
        for _ in range(rng.integers(0, 10)):
            at, kind = rng.integers(0, len(words)), rng.integers(0, 4)
            words[at : at + 1] = [[f"n{rng.integers(0, 9)}"], [f"v{family}x{at}"], [], [words[at], "the"]][kind]
        for child in range(rng.integers(1, 5)):
            copy = list(words)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = f"c{family}y{child}z{rng.integers(0, 50)}"
            texts[len(texts)] = " ".join(copy)
    expected = brute_force(texts)
    assert 5 < len({root for _, root in expected.values()}) < len(texts)
    assert result(near_duplicate_groups(table(texts.items()).repartition(5))) == expected


def test_candidates_of_a_large_group_of_copies(table, monkeypatch):
    """Copies with changes of their own are hardly ever candidates, although they lack the same words of their text."""
    rng = np.random.default_rng(3)
    texts = {}
    for k in range(300):
        words = [f"w{i}" for i in range(150)]
        for at in rng.integers(0, 150, rng.integers(1, 5)):
            words[at] = f"own{k}x{at}"
        words[-1] = "the" if k else "odd"
        texts[k] = " ".join(words)
    seen, cross_pairs = [], near_dedup._cross_pairs

    def counted(*args):
        pairs = cross_pairs(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_cross_pairs", counted)
    expected = brute_force(texts)
    assert len({root for _, root in expected.values()}) > 30
    assert result(near_duplicate_groups(table(texts.items()))) == expected
    assert seen[0] < len(texts)


def test_chains_and_thresholds(table):
    """Copies with growing edits: each links to the next, far ones only through others."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(130)]
    texts = {}
    for k in range(60):
        texts[k] = " ".join(words)
        words[rng.integers(0, 130)] = f"new{k}"
    for k in range(60, 100):
        texts[k] = " ".join(f"u{rng.integers(0, 10**9)}" for _ in range(rng.integers(1, 12)))
    assert result(near_duplicate_groups(table(texts.items()))) == brute_force(texts)


def test_odd_rows(odd, nothing):
    rows = near_duplicate_groups(odd).collect()
    assert len(rows) == len(ODD_PAIRS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in by_id[1] + by_id[2] + by_id[3]] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert {(r["component_id"], r["kept"]) for r in by_id[4]} == {(4, True)} and len(by_id[4]) == 2
    assert (by_id[5][0]["component_id"], by_id[5][0]["kept"]) == (4, False)
    assert by_id[6][0]["n_shingles"] == len(shingles(LONG))
    assert by_id[None][0]["component_id"] is None and by_id[None][0]["kept"]
    assert near_duplicate_groups(nothing).count() == 0
    kept = one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in (None, 1, 2, 3, 4, 6, 7, 8, 9, 10))


def test_many_null_ids(table):
    df = near_duplicate_groups(table([(None, "same words here again and again now")] * 5 + [(3, "same words here again and again now")]))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in df.collect()} == {(None, 3, False), (3, 3, True)}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, tolerance in ((20, 0.12), (300, 0.06), (3000, 0.06)):
        agreed, similarity = [], 0
        for _ in range(40):
            common = round(2 * n * 0.7 / 1.7)
            values = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            sets = np.concatenate([values[:n], values[:common], values[n : 2 * n - common]])
            signature = super_minhash(sets, np.array([0, n, 2 * n]), 64)
            agreed.append((signature[0] == signature[1]).mean())
            similarity = common / (2 * n - common)
        assert abs(np.mean(agreed) - similarity) < tolerance


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (2000, 2000)] + [(3000, 3000 + k) for k in range(50)]
    edges = spark.createDataFrame(chain, "a bigint, b bigint").repartition(7)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    expected = {k: 0 for k in range(1, 301)} | {1001: 1000} | {3000 + k: 3000 for k in range(1, 50)}
    assert found == expected
    assert components(edges.limit(0)).count() == 0


def test_components_by_rounds_and_in_one_task(spark):
    edges = spark.createDataFrame([(k, (k * 7 + 1) % 400) for k in range(300)], "a bigint, b bigint").repartition(9)
    by_rounds, at_once = (sorted(components(edges, n).collect()) for n in (0, 10_000))
    assert by_rounds == at_once and len(at_once) > 200
    assert components(edges, 10_000).rdd.getNumPartitions() == 1


def test_one_of_each_group_beside_any_column_name(spark):
    names = ["__kept", "__rows", "_rows", "kept", "component_id", "_id", "_n", "_k1", "_text", "node", "band", "root", "size", "n_shingles"]
    same = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, same, *names), (2, same, *names), (3, None, *names), (4, same + " ten", *names)], ["doc_id", "text", *names])
    rows = sorted(one_of_each_group(df).collect())
    assert [r["doc_id"] for r in rows] == [1, 3, 4] and all(tuple(r[2:]) == tuple(names) for r in rows)
