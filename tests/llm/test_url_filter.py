import math
import re
from collections import Counter, defaultdict

import pytest

from veilframe.llm import url_filter as uf
from veilframe.llm.queries import URL_RULES


def split_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule_by_hand(host, path):
    fits = []
    for r in URL_RULES:
        name, _, rest = r.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append(r)
    return max(fits, key=lambda r: len(r.text), default=None)


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")


ODD_URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://Example.ORG/es/x", "http://a.example.org/en/12?x#y",
    "http://example.org/en/2", "x://y://com/fr/", "http://notexample.org/es/", "http://borg/", "HTTPS://a.COM/fr/É", "http://com/de/?u=http://org/",
    "http://ÉX.org/a", "http://com#/fr/", "http://a.com/FR/", "http://com/fr/\nx",
]


def test_rules_and_parts(spark, small):
    urls = ODD_URLS + [r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    rows = {r["page_id"]: r for r in uf.judge_urls(pages(spark, urls), URL_RULES).collect()}
    assert len(rows) == len(urls)
    for k, u in enumerate(urls):
        host, path = split_by_hand(u)
        rule = rule_by_hand(host, path)
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == (host, path, rule and rule.text), u
        assert rows[k]["verdict"] in ("allow", "block")
        if rule:
            assert rows[k]["verdict"] == ("allow" if rule.allow else "block")


def test_model_by_hand(spark):
    labelled = [("a.com/x", True), ("a.com/y", True), ("b.net/x", True), ("pills.biz/q", False), ("pills.biz/win", False)] * 2
    model = uf.fit(spark.createDataFrame(labelled, "_url string, _accept boolean").repartition(3))
    counts = {True: Counter(), False: Counter()}
    for url, label in labelled:
        t = uf.BEGIN + url + uf.END
        for e in range(1, len(t)):
            for n in range(1, min(uf.ORDER, e + 1) + 1):
                counts[label][t[e + 1 - n : e + 1]] += 1
    both = counts[True] + counts[False]
    known = {g for g in both if len(g) <= 2 or both[g] >= uf.MIN_COUNT}

    def chance(gram, label):
        if not gram:
            return 1 / 256
        low = chance(gram[1:], label)
        context = gram[:-1]
        followers = defaultdict(int)
        for g in known:
            if len(g) == len(gram) and g[:-1] == context:
                followers[g] = counts[label][g]
        if context and context not in known:
            return low
        total, kinds = sum(followers.values()), sum(c > 0 for c in followers.values())
        if not total:
            return low
        return followers.get(gram, 0) / (total + kinds) + kinds / (total + kinds) * low

    for url in ("a.com/z", "pills.biz/zz", "new.org/"):
        t = uf.BEGIN + url + uf.END
        sums = {label: 0.0 for label in (True, False)}
        for e in range(1, len(t)):
            longest = min(uf.ORDER, e + 1)
            # The context is as long as the counts hold it, character by character.
            for label in (True, False):
                sums[label] += math.log(chance_at(t, e, longest, chance, known, label))
        assert model.differences([url])[0] == pytest.approx((sums[True] - sums[False]) / (len(t) - 1), abs=1e-9)


def chance_at(t, e, longest, chance, known, label):
    size = 1
    while size < longest and t[e - size : e] in known:
        size += 1
    return chance(t[e + 1 - size : e + 1], label)


def test_method_tells_hosts_apart(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    rows = uf.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES).where("rule is null").collect()
    spam = [any(w in r["host"] for w in uf.REJECTED_HOST_WORDS) for r in rows]
    right = [(r["verdict"] == "block") == s for r, s in zip(rows, spam, strict=True)]
    assert sum(right) >= 0.95 * len(rows) and any(spam)


def test_empty_and_repeated(spark):
    empty = pages(spark, ["x"]).limit(0)
    assert uf.judge_urls(empty, URL_RULES).count() == 0
    same = uf.judge_urls(pages(spark, ["http://a.net/x"] * 3 + ["http://bets.net/q"] * 3), URL_RULES).collect()
    assert len({(r["host"], r["verdict"]) for r in same}) == 2 and len(same) == 6
    long = uf.judge_urls(pages(spark, ["http://a.net/" + "x" * 100_000, "http://casino.net/"]), URL_RULES).collect()
    assert len(long) == 2


def test_rare_label_keeps_its_grams(spark):
    """Many accepted URLs with grams of their own take none from a few rejected ones."""
    import random

    rng = random.Random(4)
    accepted = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=12)) for _ in range(20_000)]
    rejected = [f"pills{k}.biz/win-{k}-now" for k in range(5)]
    rows = [(u, True) for u in accepted for _ in range(3)] + [(u, False) for u in rejected] * 2
    model = uf.fit(spark.createDataFrame(rows, "_url string, _accept boolean").repartition(4))
    codes, place, _ = uf._code_points(rejected)
    held = set(model.hashes.tolist())
    for order in range(2, uf.ORDER + 1):
        assert {int(h) for h in uf._gram_hashes(codes, order)[place >= max(order - 1, 1)]} <= held, order


def test_hot_url_leaves_the_threshold_alone(spark):
    """One URL that repeats often, or one rejected row in thousands, does not decide the threshold for all."""
    from pyspark.sql import functions as F

    hosts = [(f"news{k}.net/story/{k % 7}", True) for k in range(40)] + [(f"casino{k}.biz/win/{k % 5}", False) for k in range(4)]
    rare = spark.createDataFrame(hosts, "_url string, _accept boolean")
    for name, accept in (("news%d.net/story/1", True), ("casino%d.biz/win/1", False)):
        # Of many URLs the one with the smallest hash, so that it comes before all others.
        url = spark.range(5000).select(F.format_string(name, "id").alias("u")).orderBy(F.xxhash64("u")).first()["u"]
        hot = spark.range(6000).select(F.lit(url).alias("_url"), F.lit(accept).alias("_accept"))
        model = uf.fit(rare.union(hot))
        low, high = model.differences(["casino9.biz/win/3", "news9.net/story/2"])
        assert math.isfinite(model.threshold) and low < model.threshold <= high


def test_threshold_as_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.gauss(1 if a else -1, 1), a) for a in [True] * 400 + [False] * 30]
    cut = uf.threshold(spark.createDataFrame(rows, "_score double, _accept boolean").repartition(3))

    def wrong(t):
        below = sum(a and s < t for s, a in rows) / 400
        return below + sum((not a) and s >= t for s, a in rows) / 30

    best = min(wrong(t) for t in [s for s, _ in rows] + [99])
    assert wrong(cut) <= best + 1e-9
    for label, expected in ((True, -math.inf), (False, math.inf)):
        assert uf.threshold(spark.createDataFrame([(0.5, label)], "_score double, _accept boolean")) == expected
    assert uf.threshold(spark.createDataFrame([], "_score double, _accept boolean")) == -math.inf
