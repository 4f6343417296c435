import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import lowered
from veilframe.llm.collocations import FMIndex, coded, mine_phrases


def brute(rows, longest=3, least=10, top=2000):
    """The report from (text, lang), by the definition."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    absorbed = set()
    for (lang, g), a in candidates.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                part = (lang, g[i : i + k])
                if 100 * a >= 50 * f[part]:
                    absorbed.add(part)
    by_lang = {}
    for (lang, g), a in candidates.items():
        if (lang, g) not in absorbed:
            cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in mine_phrases(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_index_lists_all_phrases(depth):
    random = np.random.default_rng(depth)
    text = np.concatenate([[0], *[np.append(random.integers(1, 6, random.integers(1, 30)), 0) for _ in range(60)]])
    for scale in (1, 10**15):  # the second does not fit the bits of one key
        index = FMIndex(text * scale if scale == 1 else np.where(text > 0, text + scale, 0), depth)
        for length, (phrases, counts) in enumerate(index.phrases(), 2):
            runs = [tuple(text[i : i + length].tolist()) for i in range(len(text) - length + 1)]
            expected = Counter(r for r in runs if 0 not in r)
            found = [tuple((p - (scale if scale > 1 else 0)).tolist()) for p in phrases]
            assert dict(zip(found, counts.tolist(), strict=True)) == expected and found == sorted(found)


def test_documents(documents):
    rows = [(r["text"], r["lang"]) for r in documents.collect()]
    assert mined(documents.repartition(3), least=3) == brute(rows, least=3)
    assert mined(documents, longest=4, least=2, top=30) == brute(rows, 4, 2, 30)


def test_small_slices_and_ties(spark):
    rows = [(f"big red dog, big red cat; the w{k % 7} w{k % 5}\tend\vof w{k % 7} w{k % 5}!", ("en", "de", None)[k % 3]) for k in range(120)]
    rows += [("zoë zoë zoë zoë", "fr")] * 9 + [("a b a b a b", "")] * 12
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert mined(df, least=5) == brute(rows, least=5)
    assert mined(df, least=5, top=2) == brute(rows, least=5, top=2)
    slices = coded(df, "text", "lang", 500).collect()
    assert len(slices) > 10 and len({r["slice"] for r in slices}) == len(slices)


def test_odd_rows(odd, nothing):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert mined(odd, least=2) == brute(rows, least=2)
    assert mined(nothing) == []
    assert mined(odd.where("doc_id in (1, 2, 3)")) == []
