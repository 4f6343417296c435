import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_PAIRS
from veilframe.llm import language_id as lid


def counts_by_hand(words, order=lid.ORDER):
    """Kneser-Ney counts from plain loops: gram -> count."""
    full = Counter()
    for w in words:
        t = lid.BEGIN + w + lid.END
        for e in range(len(t)):
            full[t[max(0, e + 1 - order) : e + 1]] += 1
    counts = {g: c for g, c in full.items() if len(g) == order}
    level = set(counts)
    for n in range(order - 1, 0, -1):
        inner = Counter(g[1:] for g in level)
        at_begin = {g: c for g, c in full.items() if len(g) == n and g[0] == lid.BEGIN}
        counts.update(inner)
        counts.update(at_begin)
        level = set(inner) | set(at_begin)
    return counts


def test_counts_and_probabilities_by_hand(table, spark):
    texts = ["the cat, the dog and the bird", "a bird and a bird", "Die Katze und der Hund", "der Vogel und die Katze"]
    langs = ["xx", "xx", "yy", "yy"]
    rows = spark.createDataFrame(list(zip(texts, langs, strict=True)), "_text string, _lang string").repartition(3)
    found = defaultdict(dict)
    for r in lid.kneser_ney_counts(rows).collect():
        found[r["lang"]][r["gram"]] = r["count"]
    expected = {}
    for lang in ("xx", "yy"):
        words = [w for t, name in zip(texts, langs, strict=True) if name == lang for w in __import__("re").findall("[a-z]+", t.lower())]
        expected[lang] = counts_by_hand(words)
    assert dict(found) == expected

    docs = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(zip(texts, langs, strict=True))], "doc_id bigint, text string, lang string")
    model = lid.fit(docs, F.lit(True))
    # Probabilities after any history sum to one over the known characters and the unseen share.
    letters = sorted({g for c in expected.values() for g in c if len(g) == 1} - {lid.BEGIN})
    for k, lang in enumerate(model.langs):
        counts = expected[lang]

        def chance(gram, order, counts=counts, k=k):
            if order == 0:
                return float(model.base[k])
            low = chance(gram[1:], order - 1)
            same = {g: c for g, c in counts.items() if len(g) == order and g[:-1] == gram[:-1] and g != lid.BEGIN}
            if not same:
                return low
            every = [c for g, c in counts.items() if len(g) == order and g != lid.BEGIN]
            ones, twos = every.count(1), every.count(2)
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = sum(same.values())
            own = max(same.get(gram, 0) - d, 0) / total
            return own + (d * len(same) / total if order > 1 else 1.0) * low

        for word in ("cat", "katze", "zzz", "bird"):
            t = lid.BEGIN + word + lid.END
            by_hand = -sum(math.log(max(chance(t[max(0, e + 1 - lid.ORDER) : e + 1], min(e + 1, lid.ORDER)), 1e-12)) for e in range(1, len(t)))
            assert abs(model.word_scores([word])[0, k] - by_hand) < 1e-3, (lang, word)
    assert letters


def test_documents_held_out(documents, odd, nothing):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = lid.fit(documents, ~held_out)
    rows = lid.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert unseen and np.mean([r["lang_pred"] == r["lang"] for r in unseen]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    again = lid.fit(documents.repartition(6), ~held_out)
    assert (again.hashes == model.hashes).all() and np.allclose(again.share, model.share)
    found = lid.identify(odd, model).collect()
    assert len(found) == len(ODD_PAIRS)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3, 10)} == dict.fromkeys((1, 2, 3, 10), ("und", 0.0))
    assert all(r["lang_pred"] in model.langs for r in found if r["doc_id"] in (4, 7, 8, 9))
    assert lid.identify(nothing, model).count() == 0
    strange = pa.array(["中文" * 50, "²³", "the of and"])
    assert model.predict(strange, False)[0][1] == "und"
    assert model.predict(strange, True)[0][:2] == ["und", "und"]


def test_nothing_to_learn_from(odd, nothing):
    model = lid.fit(nothing, F.lit(True))
    assert {r["lang_pred"] for r in lid.identify(odd, model).collect()} == {"und"}


def test_rare_language_keeps_its_grams(spark):
    """A language whose words hold nearly all grams of four letters takes none from a rare one."""
    rng = np.random.default_rng(3)
    noise = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (300, 500, 10))
    rows = [(k, " ".join("".join(w) for w in text), "noise") for k, text in enumerate(noise)]
    rare = ["katze hund vogel maus", "ente fisch pferd"]
    rows += [(1000 + k, t, "rare") for k, t in enumerate(rare)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lid.fit(docs, F.lit(True))
    expected = counts_by_hand(" ".join(rare).split())
    column = model.langs.index("rare")
    for order in (3, 4):
        grams = [g for g in expected if len(g) == order]
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64)
        hashes = lid._gram_hashes(codes, order)[order - 1 :: order]
        at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
        assert (model.hashes[at] == hashes).all() and (model.share[at, column] > 0).all(), order


def test_pruning_is_closed_and_by_language(documents, monkeypatch):
    monkeypatch.setattr(lid, "KEEP", 8)
    rows = documents.where("lang is not null and text is not null").selectExpr("text as _text", "lang as _lang")
    counts = lid.kneser_ney_counts(rows)
    every = {(r["lang"], r["gram"]): r for r in counts.collect()}
    kept = {(r["lang"], r["gram"]): r for r in lid.kept_grams(counts).collect()}
    for lang in {name for name, _ in every}:
        own = {g: r for (name, g), r in every.items() if name == lang}
        least = math.isqrt(sum(r["occurrences"] for g, r in own.items() if len(g) == 1)) // 8
        assert least > 1
        mine = {g for name, g in kept if name == lang}
        assert mine == {g for g, r in own.items() if len(g) <= 2 or r["occurrences"] >= least}
        assert len(mine) < len(own) and any(len(g) == 4 for g in mine)
        assert all(g[:-1] in mine and (g[1:] in mine) for g in mine if len(g) > 1)
    for (lang, gram), r in kept.items():
        if len(gram) == 3:
            assert r["total"] == sum(x["count"] for (name, g), x in every.items() if name == lang and len(g) == 3 and g[:-1] == gram[:-1])
            break
    model = lid.fit(documents, F.lit(True))
    # The probabilities after a context still sum to one over the alphabet and the unseen share.
    letters = sorted({g for _, g in kept if len(g) == 1} - {lid.BEGIN})
    for k in range(len(model.langs)):
        ends = [model.word_scores([w])[0, k] for w in ("t", "th", "the")]
        assert all(np.isfinite(ends))
    first = np.array([[math.exp(-x) for x in model.word_scores([c])[0]] for c in letters if c != lid.END])
    assert (first.sum(axis=0) <= 1 + 1e-6).all()


def test_repeated_document_is_calibrated_once(spark, monkeypatch):
    """Rows of one key that repeat often are measured once; what comes to the driver is bounded by rows, not keys."""
    seen = []
    real = lid.map_slices

    def counted(df, *rest):
        if "_lang" in df.columns:
            seen.append(df.count())
        return real(df, *rest)

    monkeypatch.setattr(lid, "map_slices", counted)
    rows = [(1, "the hot text in the corpus", "en")] * 500 + [(k, f"the text number {k} of a corpus", "en") for k in range(2, 6)] + [(9, "der kalte Text", "de")]
    lid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5), F.lit(True))
    assert seen == [6]
