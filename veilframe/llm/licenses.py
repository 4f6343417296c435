"""License notices: exact phrases, and fuzzy short notices by seeds and bounded-error matching.

A notice that is allowed k edits is split into k + 1 pieces. Whatever the k edits are, they leave
one piece whole (the pigeonhole principle), so an exact search for the pieces finds every place
where the notice can be. Only around those places does the ``regex`` library look for the whole
notice with at most k errors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import NOT_ALNUM, Words, batch_of, column_of, map_slices, words_of

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices in the form that texts are brought to (words with single spaces).
NOTICES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-notice": "licensed under a creative commons attribution sharealike license",
    "gpl-notice": "licensed under the gnu general public license version 3",
    "lgpl-notice": "licensed under the gnu lesser general public license",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-notice": "subject to the terms of the mozilla public license",
    "reserved-notice": "copyright all rights reserved no part of this work may be reproduced",
}
LETTERS_PER_EDIT = 10
NOTICE_TYPE = "array<struct<label:string,start_word:bigint,end_word:bigint,edits:int>>"


@dataclass
class Notice:
    label: str
    text: str
    edits: int
    pattern: regex.Pattern
    trigrams: frozenset[str]

    def may_be_in(self, area: str) -> bool:
        """Whether enough of the area's trigrams are the notice's: an edit spoils three of them at most."""
        own = self.trigrams
        return sum(area[k : k + 3] in own for k in range(len(area) - 2)) >= len(self.text) - 2 - 3 * self.edits

    def pieces(self) -> list[tuple[int, str]]:
        """Starts and texts of the edits + 1 pieces."""
        cuts = [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Starts:
    """The first bytes of all pieces, as a table that most places of a text fail at once."""

    size: int
    table: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> Starts:
        encoded = [p.encode() for p in pieces]
        size = min([8, *map(len, encoded)])
        table = np.zeros(1 << 20, bool)
        for p in encoded:
            table[cls.slots(np.frombuffer(p[:size], np.uint8), size)] = True
        return cls(size, table)

    @staticmethod
    def slots(data: np.ndarray, size: int) -> np.ndarray:
        """A 20-bit number of the ``size`` bytes from each place."""
        n = max(len(data) - size + 1, 0)
        key = np.zeros(n, np.uint64)
        for k in range(size):
            key = key << np.uint64(8) | data[k : k + n]
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def rows(self, data: np.ndarray, at: np.ndarray) -> list[int]:
        """Rows of ``data`` that may hold a piece."""
        hits = np.flatnonzero(self.table[self.slots(data, self.size)])
        return np.unique(np.searchsorted(at, hits, side="right") - 1).tolist()


@cache
def _searcher(notices: tuple[tuple[str, str], ...]) -> tuple[list[Notice], ahocorasick.Automaton, Starts]:
    found, places = [], {}
    for label, text in notices:
        edits = max(1, len(text) // LETTERS_PER_EDIT)
        trigrams = frozenset(text[k : k + 3] for k in range(len(text) - 2))
        notice = Notice(label, text, edits, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}"), trigrams)
        for start, piece in notice.pieces():
            places.setdefault(piece, []).append((len(found), start, len(piece)))
        found.append(notice)
    automaton = ahocorasick.Automaton()
    for piece, where in places.items():
        automaton.add_word(piece, where)
    automaton.make_automaton()
    return found, automaton, Starts.of(list(places))


def fuzzy_notices(text: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int]]:
    """(label, first letter, end letter, edits) of each notice in a text of words with single spaces.

    Of overlapping matches of one notice the first one is given.
    """
    known, automaton, _ = _searcher(notices)
    at: dict[int, list[tuple[int, int]]] = {}
    for end, where in automaton.iter(text):
        for number, start, size in where:
            n = known[number]
            begin = end + 1 - size - start
            at.setdefault(number, []).append((max(0, begin - n.edits), min(len(text), begin + len(n.text) + n.edits)))
    found = []
    for number, areas in at.items():
        n = known[number]
        areas.sort()
        merged = [areas[0]]
        for low, high in areas[1:]:
            if low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        for low, high in merged:
            if not n.may_be_in(text[low:high]):
                continue
            while low < high and (m := n.pattern.search(text, low, high)):
                found.append((n.label, m.start(), m.end(), sum(m.fuzzy_counts)))
                low = m.end()
    return sorted(found, key=lambda f: (f[1], f[0]))


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row's words joined by single spaces, and where each row begins."""
    inside = ~NOT_ALNUM[words.data]
    follows = np.zeros(len(inside), bool)  # the first separator after a word
    ends = words.ends[~np.isin(words.ends, words.bytes_at)]  # not at the end of a row
    follows[ends] = True
    kept = inside | follows
    data = np.where(inside, words.data, 0x20).astype(np.uint8)
    total = np.concatenate([[0], np.cumsum(kept)])
    return data[kept], total[words.bytes_at]


def _phrase_places(words: Words, phrases: dict[str, str]) -> list[tuple[np.ndarray, str]]:
    """First words of all places of each phrase."""
    left = words.left_in_row()
    out = []
    for phrase, label in phrases.items():
        wanted = words_of(pa.array([phrase]), NOT_ALNUM).hashes
        at = np.flatnonzero(words.hashes == wanted[0])
        at = at[left[at] >= len(wanted)]
        for k in range(1, len(wanted)):
            at = at[words.hashes[at + k] == wanted[k]]
        out.append((at, label))
    return out


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels (array), notices (label, words, edits), score.

    ``n_base`` counts the places of the phrases, first_word and last_word are the smallest and
    largest place (null without one). ``notices`` are the fuzzy matches, by start; their words run
    from start_word to before end_word. The score is 1 with a phrase, else the share of letters
    that the best notice has unedited, else 0. Null and empty texts have no words. Rows are
    scanned each by itself; a null key stays null. Other columns are not looked at.
    """
    phrases = PHRASES if phrases is None else phrases
    table = tuple(sorted((NOTICES if notices is None else notices).items()))
    length = {label: len(t) for label, t in table}
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(column_of(batch, "_text"), NOT_ALNUM)
        n = len(batch)
        counts = np.zeros(n, np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in range(n)]
        for at, label in _phrase_places(words, phrases):
            row = np.searchsorted(words.rows, at, side="right") - 1
            counts += np.bincount(row, minlength=n)
            np.minimum.at(first, row, at - words.rows[row])
            np.maximum.at(last, row, at - words.rows[row])
            for r in set(row.tolist()):
                labels[r].add(label)
        found: list[list[dict]] = [[] for _ in range(n)]
        scores = np.where(counts > 0, 1.0, 0.0)
        plain, at = spaced(words)
        for k in _searcher(table)[2].rows(plain, at) if table else ():
            row_text = plain[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")
            for label, a, b, e in fuzzy_notices(row_text, table):
                first_word, end_word = row_text.count(" ", 0, a), row_text.count(" ", 0, b - 1) + 1
                found[k].append({"label": label, "start_word": first_word, "end_word": end_word, "edits": e})
                scores[k] = max(scores[k], 1 - e / length[label])
        none = counts == 0
        notice_type = pa.list_(
            pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])
        )
        return batch_of(
            _key=column_of(batch, "_key"),
            n_words=np.diff(words.rows).astype(np.int64),
            n_base=counts,
            first_word=pa.array(first, pa.int64(), mask=none),
            last_word=pa.array(last, pa.int64(), mask=none),
            base_labels=pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
            notices=pa.array(found, notice_type),
            score=pa.array(scores, pa.float64()),
        )

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    schema = (
        f"_key {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        f"base_labels array<string>, notices {NOTICE_TYPE}, score double"
    )
    return map_slices(rows, "_text", run, schema).withColumnRenamed("_key", key)


def license_labels(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The scan with its labels as sorted comma-joined text: base ones, and those with the notices' own."""
    every = F.array_sort(F.array_union("base_labels", F.array_distinct(F.transform("notices", lambda n: n["label"]))))
    return scanned.select(
        key,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", every).alias("labels"),
        "score",
    )
