import math
import re

import numpy as np

from tests.llm.conftest import LONG, ODD_PAIRS
from veilframe.llm import quality as q


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    repeated = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(repeated) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
REPEATS = "a b c d e f g h i j k l m n o p q r s t u v w x y z "
TEXTS = [
    REPEATS * 2,
    REPEATS + "a b c d e f g h",
    REPEATS + "a b c d e f g",
    "x " * 40,
    "x y " * 8,
    "line one\nline one\n \nline one \n\n\nLine one\n" + REPEATS,
    "a b c é|é #x# 😀😀\u0085" + REPEATS,
    " ".join(f"w{k}" for k in range(50)) + " " + " ".join(f"w{k}" for k in range(20, 40)) + " end " + " ".join(f"w{k}" for k in range(5, 14)),
    "\x0b\x0c\r\n",
]


def test_statistics_by_hand(table, documents, plain):
    for df, texts in ((documents, plain), (table(enumerate(TEXTS)), dict(enumerate(TEXTS)))):
        rows = q.judge_quality(df).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert tuple(r[c] for c in COLUMNS) == by_hand(texts[r["doc_id"]]), texts[r["doc_id"]][:200]
            assert not (r["base_failed"] and r["kept"])


def numpy_estimate(x, subset, steps):
    """The same concentration steps in numpy, with exact quantiles."""
    floors = np.diag([f**2 for f in q.FLOORS.values()])
    results = []
    for start in (0, 1):
        centre = np.array([np.sort(c)[(len(c) - 1) // 2] for c in x.T]) if start == 0 else x.mean(axis=0)
        cov = floors if start == 0 else np.cov(x.T, bias=True) + floors
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[d <= np.sort(d)[math.ceil(len(d) * subset) - 1]]
            centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floors
        results.append((np.linalg.det(cov), centre, cov))
    return min(results, key=lambda r: r[0])


def test_estimates_as_numpy(spark):
    rng = np.random.default_rng(2)
    data = []
    for group, n in (("a", 400), ("b", 150)):
        x = rng.standard_normal((n, 4)) @ rng.standard_normal((4, 4)) * 0.3 + rng.standard_normal(4)
        x[: n // 8] += 9
        data += [(group, "s", *map(float, row)) for row in x]
    rows = spark.createDataFrame(data, "_a string, _b string, x_0 double, x_1 double, x_2 double, x_3 double")
    found = {r["_a"]: r for r in q.robust_estimates(rows).collect()}
    for group in "ab":
        x = np.array([r[2:] for r in data if r[0] == group])
        _, centre, cov = numpy_estimate(x, q.SUBSET_PERCENT / 100, q.STEPS)
        r = found[group]
        root = np.array([[r[f"l_{j}{k}"] if k <= j else 0.0 for k in range(4)] for j in range(4)])
        assert np.allclose([r[f"m_{j}"] for j in range(4)], centre, atol=0.02)
        assert np.allclose(root @ root.T, cov, atol=0.02)


def test_junk_goes_and_clean_text_stays(table):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    clean = [" ".join(word() for _ in range(rng.integers(30, 300))) for _ in range(200)]
    junk = [" ".join(word() + "%%%#" for _ in range(60)) for _ in range(10)]
    rows = {r["doc_id"]: r for r in q.judge_quality(table(enumerate(clean + junk))).collect()}
    assert all(rows[k]["kept"] for k in range(200))
    assert not any(rows[k]["kept"] for k in range(200, 210))


def test_odd_rows(odd, nothing):
    rows = q.judge_quality(odd).collect()
    assert sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS]) for r in rows) == sorted((str(i), *by_hand(t)) for i, t in ODD_PAIRS)
    assert {r["distance"] for r in rows} == {0.0}
    assert by_hand(LONG)[-1] and q.judge_quality(nothing).count() == 0
