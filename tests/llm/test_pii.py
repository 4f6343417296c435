import hashlib
import random
import re

from tests.llm.conftest import ODD_PAIRS
from veilframe.llm.pii import KINDS, base_spans, digests, find_personal_data, redacted


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    """The shapes as they are written down, with the plain patterns."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [
        (m.start(), 1, m.end())
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m.group().split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_shapes_as_plain_patterns(plain):
    rng = random.Random(1)
    texts = list(plain.values())
    texts += ["".join(rng.choice("ab1. @+-()%é0") for _ in range(rng.randint(1, 60))) for _ in range(20_000)]
    texts += ["".join(rng.choice("12345. ") for _ in range(rng.randint(10, 60))) for _ in range(5_000)]
    texts += ["4111 1111-1111 1111", "a@b@c.de", "x@y..z", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.0.0.0001", "@a.b", "a@@b.c"]
    for t in texts:
        assert base_spans(t) == plain_spans(t), t


def test_documents(documents, plain):
    rows = digests(find_personal_data(documents)).collect()
    assert len(rows) == len(plain)
    for r in rows:
        spans = plain_spans(plain[r["doc_id"]])
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(written.split(",")) <= set(r["spans"].split(",")) | {""}


def test_context_discovers_unseen_identifiers(table):
    rng = random.Random(3)
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = [(k, f"some text call me under {phone()} today or write") for k in range(12)]
    texts += [(100, "other text call me under 555-0199-123 today then"), (101, "ordinal number 555-0199-777 of parts"), (102, "call me under the bridge today")]
    found = {r["doc_id"]: r["spans"] for r in find_personal_data(table(texts)).collect()}
    assert [s["kind"] for s in found[100]] == [KINDS.index("phone")]
    text = dict(texts)[100]
    assert text[found[100][0]["start"] : found[100][0]["end"]] == "555-0199-123"
    assert not found[101] and not found[102]
    masked = {r["doc_id"]: r["text"] for r in redacted(table(texts)).collect()}
    assert masked[100] == "other text call me under [phone] today then"
    assert masked[101] == dict(texts)[101] and masked[0].startswith("some text call me under [phone] today")


def test_odd_rows(odd, nothing, table):
    rows = digests(find_personal_data(odd)).collect()
    assert len(rows) == len(ODD_PAIRS) and all(r["spans"] == "" for r in rows)
    assert digests(find_personal_data(nothing)).count() == 0
    kept = redacted(odd)
    assert kept.schema == odd.schema
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    twice = table([(None, "mail a.b@c.de now"), (None, "mail a.b@c.de now"), (1, None), (1, "ip 1.2.3.4, x@y.zz")])
    assert sorted(str(r["text"]) for r in redacted(twice).collect()) == ["None", "ip [ip], [email]", "mail [email] now", "mail [email] now"]
    assert redacted(nothing).count() == 0


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000 + ".2.3", "a" * 300_000 + "@", "a" * 300_000 + " b@c.de", "+" + "1 " * 150_000):
        assert base_spans(t) == [s for s in base_spans(t) if s[2] - s[0] < 100]


def spans_in(found, texts):
    return {k: [(KINDS[s["kind"]], t[s["start"] : s["end"]]) for s in found[k]] for k, t in texts}


def test_digits_joined_by_blanks_and_parentheses(table):
    rng = random.Random(8)
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = [(k, f"some text call me under {phone()} today or write") for k in range(14)]
    others = ["030 123 4567", "(743) 555-3824", "0711/445 566", "(030) 123.45.67"]
    texts += [(100 + k, f"other text call me under {value} today then") for k, value in enumerate(others)]
    texts += [(200, "chapter 030 123 4567 of the list"), (201, "call me under (555 0199 123) today")]
    rows = {r["doc_id"]: r["spans"] for r in find_personal_data(table(texts)).collect()}
    spans = spans_in(rows, texts)
    for k, value in enumerate(others):
        assert spans[100 + k] == [("phone", value)], value
    assert spans[201] == [("phone", "555 0199 123")]
    # The same value in a context that says nothing: values are vouched for, wherever they stand.
    assert spans[200] == [("phone", "030 123 4567")]
    masked = {r["doc_id"]: r["text"] for r in redacted(table(texts)).collect()}
    assert masked[101] == "other text call me under [phone] today then"


def test_discovered_instances_induce_patterns(table):
    """Identifiers found in one context admit a second one, which holds no exact shape at all."""
    rng = random.Random(9)
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = [(k, f"some text call me under {phone()} today or write") for k in range(30)]
    known = [f"0{rng.randrange(100, 999)}-{rng.randrange(10**6, 10**7)}" for _ in range(5)]
    texts += [(100 + k, f"other text call me under {v} today then") for k, v in enumerate(known)]
    texts += [(200 + k, f"the hotline reaches {v} always") for k, v in enumerate(known)]
    texts += [(300, "the hotline reaches 0999-7654321 always"), (301, "the invoice lists 0999-1234567 only")]
    rows = {r["doc_id"]: r["spans"] for r in find_personal_data(table(texts)).collect()}
    spans = spans_in(rows, texts)
    assert all(spans[200 + k] == [("phone", v)] for k, v in enumerate(known))
    assert spans[300] == [("phone", "0999-7654321")]
    assert not spans[301]


def test_grouped_digits_take_linear_time():
    from veilframe.llm.pii import _grouped

    for t in ("1 " * 150_000, "1" * 300_000 + "x", "(" * 300_000, "1(" * 150_000 + "x", "(1 2)" * 60_000):
        assert _grouped(t, []) == []


def test_redaction_beside_any_column_name(spark):
    names = ["_other_key", "__other_key", "_other_print", "_spans", "__spans", "_key", "_print", "_text", "spans", "base", "kind", "value", "m"]
    df = spark.createDataFrame([(1, "write to me@example.org", *names), (2, None, *names)], ["doc_id", "text", *names])
    rows = sorted(redacted(df).collect())
    assert [r["text"] for r in rows] == ["write to [email]", None] and [tuple(r[2:]) for r in rows] == [tuple(names)] * 2
