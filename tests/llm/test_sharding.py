import zlib
from collections import Counter

import pytest

from tests.llm.conftest import ODD_PAIRS
from veilframe.llm.sharding import shard_documents


def check_law(rows, texts, shards):
    """``texts``: (key, text) pairs. Sizes even, slots gapless, columns right; returns documents per (text, shard)."""
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and set(counts) <= set(range(shards))
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    sizes = Counter((k, 16 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for k, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sizes
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)} or not rows


def cut_groups(rows):
    where = {}
    for r in rows:
        if r["text_crc32"] is not None:
            where.setdefault((r["text_crc32"], r["size"]), Counter())[r["shard"]] += 1
    return where


def test_documents(documents, plain):
    rows = shard_documents(documents).collect()
    check_law(rows, list(plain.items()), 40)


@pytest.mark.parametrize("partitions", [1, 5, 9])
def test_groups_stay_together(table, partitions):
    texts = [(k, f"text {k % 300}") for k in range(900)] + [(1000 + k, "the hot one") for k in range(700)] + [(5000 + k, f"single {k}") for k in range(400)]
    df = table(texts).repartition(partitions)
    rows = shard_documents(df, shards=10).collect()
    check_law(rows, texts, 10)
    where = cut_groups(rows)
    hot = max(where.values(), key=lambda c: c.total())
    assert hot.total() == 700 and len(hot) <= 7  # 4 shards would do, by chance it is in all 10
    cut = sum(len(c) > 1 for c in where.values() if c.total() == 3)
    assert cut <= 30  # nine of ten small groups are whole; by chance it would be 1 in 100
    again = shard_documents(table(texts).repartition(3), shards=10).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_all_in_one_group(table):
    texts = [(k, "same") for k in range(95)]
    check_law(shard_documents(table(texts), shards=10).collect(), texts, 10)


def test_odd_rows(odd, nothing, table):
    check_law(shard_documents(odd).collect(), ODD_PAIRS, 40)
    check_law(shard_documents(odd, shards=3).collect(), ODD_PAIRS, 3)
    assert shard_documents(nothing).count() == 0
    nulls = [(None, None)] * 30 + [(None, "x")] * 30
    check_law(shard_documents(table(nulls), shards=4).collect(), nulls, 4)
