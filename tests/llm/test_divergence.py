import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tests.llm.conftest import lowered
from veilframe.llm.corpus_slices import coded_words, packed, unpacked
from veilframe.llm.divergence import TERM_BYTES, audit_sources, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs, top):
    """All rows of the audit from (text, lang, source), by the definition."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lowered(text))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = {}
        for s in sources:
            total = sum(counts[lang, s][t] for t in kept)
            share[s] = {t: 1 + 1_000_000_000 * (counts[lang, s][t] + 5) // (total + 5 * len(kept)) for t in kept}
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        everything = {t: 1 + 1_000_000_000 * (whole[t] + 5) // (whole.total() + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, share[s][t] - everything[t]) for t in kept if counts[lang, s][t] and share[s][t] > everything[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in audit_sources(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_documents(documents):
    rows = [(r["text"], r["lang"], r["source"]) for r in documents.collect()]
    assert audited(documents.repartition(3), least_docs=4, top=7) == brute(rows, 4, 7)


def test_odd_rows(odd, nothing, spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert audited(odd, least_docs=2) == brute(rows, 2, 50)
    assert audited(odd, least_docs=100) == brute(rows, 100, 50)  # no term is kept, pairs are 0
    assert audited(nothing) == []
    signs = [("foo-foo foo. (foo) l'eau", "fr", "a"), ("foo...", "fr", "b"), ("7 8 --", "fr", "c"), ("É é\x00x", "fr", "b")]
    df = spark.createDataFrame(signs, "text string, lang string, source string")
    assert audited(df, least_docs=1) == brute(signs, 1, 50)


def test_a_hot_source_and_repeated_rows(spark):
    rows = [("the same words again, and again", "en", "hot")] * 400 + [(f"word{'abc'[k % 3]} the other", "en", f"s{k % 5}") for k in range(100)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert audited(df, least_docs=20) == brute(rows, 20, 50)


def test_counts_over_many_slices(documents):
    rows = [(r["text"], r["lang"], r["source"]) for r in documents.collect()]
    docs, n = Counter(), Counter()
    for text, lang, source in rows:
        terms = TERM.findall(lowered(text))
        docs.update((lang, source, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    found = {tuple(r)[:3]: (r["docs"], r["n"]) for r in term_counts(documents, size=20_000).collect()}
    assert found == {key: (docs[key], n[key]) for key in docs}


def test_words_are_stripped_and_numbers_packed():
    words = coded_words(pa.array(["«Ab, x9y -- (é)", None, "zz"]), inner=TERM_BYTES)
    assert [words.vocabulary[int(c)].as_py() for c in words.codes] == ["«ab", "x9y", "é", "zz"]
    assert words.rows.tolist() == [0, 3, 3, 4]
    for values in ([], [0, 0], [255, 256, 7], [2**62, 1]):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values
