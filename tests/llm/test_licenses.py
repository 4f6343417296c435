import re

from tests.llm.conftest import ODD_PAIRS, lowered
from veilframe.llm.licenses import LETTERS_PER_EDIT, NOTICES, PHRASES, fuzzy_notices, license_labels, scan_licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TABLE = tuple(sorted(NOTICES.items()))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        before, row = row, [row[0] + 1]
        for k, y in enumerate(b):
            row.append(min(before[k] + (x != y), before[k + 1] + 1, row[k] + 1))
    return row[-1]


def by_hand(text):
    words = WORDS.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(wanted)] == wanted]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_documents_by_hand(documents, plain):
    rows = license_labels(scan_licenses(documents)).collect()
    assert len(rows) == len(plain)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == by_hand(plain[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_base_texts(table):
    texts = [
        "The MIT License, the mit\nlicense; CC-BY and cc by! GNU General Public License",
        "mitlicense MIT  licenses cc bye",
        "Apache. License apache license APACHE LICENSE",
        "",
        None,
    ]
    rows = {r["doc_id"]: r for r in license_labels(scan_licenses(table(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == by_hand(t)


def test_every_edit_within_the_bound_is_found():
    """Each notice with its bound of edits, spread in every way of a few, is found with its span."""
    for label, notice in NOTICES.items():
        bound = max(1, len(notice) // LETTERS_PER_EDIT)
        for step in range(3):
            letters = list(notice)
            for e in range(bound):
                at = (e * len(notice)) // bound + step + 2
                if at < len(letters):
                    letters[at] = "" if step == 0 else "q" if step == 1 else letters[at] + "q"
            text = "zz yy " + "".join(letters) + " xx"
            found = [f for f in fuzzy_notices(text, TABLE) if f[0] == label]
            assert found, (label, text)
            _, a, b, edits = found[0]
            assert edits <= bound and edit_distance(text[a:b], notice) <= bound


def test_spans_count_words(table):
    text = "First words, then:\nReleased   under the MIT-Licence!! and more"
    row = scan_licenses(table([(1, text)])).first()
    assert [(n["label"], n["start_word"], n["end_word"], n["edits"]) for n in row["notices"]] == [("mit-notice", 3, 8, 1)]
    assert row["n_base"] == 0 and 0.9 < row["score"] < 1


def test_odd_rows(odd, nothing):
    rows = license_labels(scan_licenses(odd)).collect()
    assert len(rows) == len(ODD_PAIRS)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"]) for r in rows) == sorted((str(i), *by_hand(t)[:2]) for i, t in ODD_PAIRS)
    assert license_labels(scan_licenses(nothing)).count() == 0
