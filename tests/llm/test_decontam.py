import random
import re

import pytest

from veilframe.llm.decontam import MASKS, best_stretch, contaminated, without_contaminated


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute_force(texts, items):
    """All diagonals of all pairs: those with a seed of any mask are scored word by word."""
    found = {}
    for key, text in texts:
        words = folded(text)
        places = {}
        for p, w in enumerate(words):
            places.setdefault(w, []).append(p)
        for item, content in items:
            theirs = folded(content)
            if len(theirs) < 6 or sum(w in places for w in theirs) < min(12, len(theirs)):
                continue
            best = None
            for shift in {p - q for q, w in enumerate(theirs) for p in places.get(w, ())}:
                low, high = max(0, -shift), min(len(theirs), len(words) - shift)
                equal = [theirs[q] == words[q + shift] for q in range(low, high)]
                if not any(all(equal[k + m] for m in mask) for mask in MASKS for k in range(len(equal) - mask[-1])):
                    continue
                a, b = best_stretch(__import__("numpy").array(equal))
                same = sum(equal[a:b])
                if same >= min(12, len(theirs)):
                    entry = (-same, b - a, low + shift + a)
                    best = min(best or entry, entry)
            if best:
                found[key, item] = (len(theirs), -best[0], best[1], best[2])
    return found


def result(df):
    return {(r["doc_id"], r["item_id"]): (r["item_words"], r["equal_words"], r["stretch_words"], r["start_word"]) for r in df.collect()}


@pytest.fixture(scope="module")
def benchmark(spark, small):
    return spark.read.parquet(f"{small}/benchmark.parquet")


def test_documents_as_brute_force(documents, plain, benchmark):
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    expected = brute_force(plain.items(), items)
    assert expected
    assert result(contaminated(documents, benchmark)) == expected
    clean = {r["doc_id"] for r in without_contaminated(documents, benchmark).collect()}
    assert clean == set(plain) - {k for k, _ in expected}


def test_substituted_words(table, spark):
    """A passage with every fifth, every third or scattered words substituted is still found; loose words are not."""
    rng = random.Random(2)
    item = [f"word{k}" for k in range(40)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    fifth = [w if k % 5 else "changed" for k, w in enumerate(item)]
    fourth = [w if k % 4 else "changed" for k, w in enumerate(item)]
    scattered = item[:]
    for k in rng.sample(range(40), 7):
        scattered[k] = "other"
    shuffled = rng.sample(item, 40)
    texts = [(k, " ".join(filler(30) + w + filler(30))) for k, w in enumerate((item, fifth, fourth, scattered, shuffled, item[:11], filler(40)))]
    texts.append((9, " ".join(item).upper().replace(" ", ", ")))
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (None, "too few words here"), (5, "six words make one short item")], "item_id bigint, text string")
    found = result(contaminated(table(texts), items))
    assert {k for k, _ in found} == {0, 1, 2, 3, 9}
    assert found == brute_force(texts, [(1, " ".join(item))])


def test_odd_rows(odd, nothing, benchmark, spark):
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven twelve")], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in contaminated(odd, items).collect()) == [4, 4, 5]
    kept = without_contaminated(odd, items)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3
    assert contaminated(nothing, items).count() == 0 and contaminated(odd, items.limit(0)).count() == 0
    assert without_contaminated(odd, items.limit(0)).count() == odd.count()
    assert without_contaminated(nothing, items).count() == 0


def leaks_by_plain_rule(text, item):
    """All stretches of all diagonals, without seeds and without the operator's rule."""
    ours, theirs = text.lower().split(), item.lower().split()
    n = len(theirs)
    need = n if n < 6 else min(12, (3 * n + 3) // 4)
    for shift in range(-n + 1, len(ours)):
        equal = [0 <= q + shift < len(ours) and ours[q + shift] == w for q, w in enumerate(theirs)]
        for a in range(n):
            same = 0
            for b in range(a, n):
                same += equal[b]
                if same >= need and 2 * same >= b + 1 - a:
                    return True
    return False


def test_regular_substitutions_and_short_items(table, spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    items, texts = [], []

    def plant(item, equal):
        changed = [w if e else f"s{rng.randrange(10**7)}" for w, e in zip(item, equal, strict=True)]
        items.append((len(items), " ".join(item)))
        texts.append((len(texts), " ".join(words(20) + changed + words(20))))

    for n in (24, 40, 60):
        for pattern in ("EES", "ES", "SE", "EEESS", "EESS", "EEES", "ESS", "EESSSS"):
            plant(words(n), [pattern[k % len(pattern)] == "E" for k in range(n)])
    for n in range(1, 20):
        for substituted in range(5):
            for _ in range(3):
                out = set(rng.sample(range(n), min(substituted, n)))
                plant(words(n), [k not in out for k in range(n)])
    expected = {(k, k) for k, text in texts if leaks_by_plain_rule(text, items[k][1])}
    # Every third, alternate, EEESS, EESS and EEES leak in all sizes; ESS and EESSSS in none.
    assert {k for k, _ in expected if k < 24} == {k for k in range(24) if k % 8 < 6}
    # 11 of 12 words leak; four of five do not.
    found = result(contaminated(table(texts), spark.createDataFrame(items, "item_id bigint, text string")))
    assert set(found) == expected
    eleven = [k for k, (_, item) in enumerate(items) if len(item.split()) == 12 and found.get((k, k), (0, 0))[1] == 11]
    assert len(eleven) == 3
    assert {k for k, _ in found if len(items[k][1].split()) < 6} == {k for k in range(24, 24 + 5 * 15) if items[k][1] in texts[k][1]}
