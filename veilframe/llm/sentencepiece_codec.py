"""SentencePiece encoding and decoding with a merge-type model, by a table of prefix ends.

Merging by priority has a property that makes a linear method exact: a sequence of pieces is
the encoding of a text if each piece encodes to itself and each two neighbours stay apart when
merged together. So every prefix of a text has one last piece. The table holds it for each
prefix: an automaton gives the pieces that end there, and the one piece is taken that fits the
last piece of the prefix before it. Reading the table backwards gives the ids.

A text is cut where the vocabulary has no piece across the cut, and the ids of short parts are
remembered, with a bound on their number.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import chain, groupby
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from veilframe.llm.common import batch_of, column_of, map_slices, mix, texts_of

MARK = "▁"
REMEMBERED = 100_000  # parts whose ids a task keeps, twice over: the newer and the older half
REMEMBERED_LENGTH = 40
ID_BITS = 21
ALPHABET = 160  # characters with a row in the automaton table; parts with others take a slower way
PAIR_SLOTS = 1 << 20  # remembered answers of the pair test, one to a slot


class Codec:
    """Encoder and decoder for one merge-type model file."""

    def __init__(self, model_path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.library = library
        self.byte_ids = [0] * 256
        self.rank: dict[str, float] = {}  # a smaller rank merges earlier
        self.id: dict[str, int] = {}
        self.piece: list[str] = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            self.piece.append(piece)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.rank[piece] = -library.get_score(i)
                self.id[piece] = i
        self.halves: dict[str, tuple[str, str]] = {}
        automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if self._is_own_encoding(piece):
                automaton.add_word(piece, (self.id[piece], len(piece)))
        automaton.make_automaton()
        self.automaton = automaton
        self.characters = frozenset(p for p in self.rank if len(p) == 1)
        self.parts = self._cutter()
        self._make_tables()
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.decimals = [str(i) for i in range(library.get_piece_size())]

    def _cutter(self):
        """Function that cuts a marked text into parts that no merge can cross.

        Cuts lie before runs of word marks and between plain characters (line ends, digits,
        punctuation, and what shares a piece with them) and all others, wherever the vocabulary
        has no piece across; else the text stays whole.
        """
        longer = list(self.halves)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in longer):
            return lambda text: [text]
        neighbours: dict[str, set[str]] = {}
        for p in longer:
            q = p.lstrip(MARK)
            for a, b in zip(q, q[1:], strict=False):
                neighbours.setdefault(a, set()).add(b)
                neighbours.setdefault(b, set()).add(a)
        plain = {chr(c) for c in range(128) if not chr(c).isalpha()}
        waiting = list(plain)
        while waiting:
            for c in neighbours.get(waiting.pop(), ()):
                if c not in plain:
                    plain.add(c)
                    waiting.append(c)
        if any(c.isalpha() and c.isascii() for c in plain):
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        inside = "".join(re.escape(c) for c in sorted(plain - {MARK, "\n"}))
        line_end = "" if "\n" in neighbours or "\n" in self.rank else "\n|"
        inside += "" if line_end else "\n"
        return re.compile(f"{line_end}{MARK}*[^{inside}{MARK}\n]+|{MARK}*[{inside}]+|{MARK}+").findall

    def _is_own_encoding(self, piece: str) -> bool:
        """Merge the characters of a piece; remembers the halves of the last merge."""
        symbols, rank = list(piece), self.rank
        if len(symbols) == 1:
            return True
        while len(symbols) > 1:
            best, at = inf, -1
            for k in range(len(symbols) - 1):
                r = rank.get(symbols[k] + symbols[k + 1], inf)
                if r < best:
                    best, at = r, k
            if at < 0:
                return False
            if len(symbols) == 2:
                self.halves[piece] = (symbols[0], symbols[1])
                if any(len(h) > 1 and rank[h] > rank[piece] for h in symbols):
                    raise ValueError(f"{piece} ranks before its halves; this is no merge-type model")
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return True

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the two texts together yields exactly these two pieces.

        Walks back through the merges that made the two pieces, latest first. At each step the
        symbols at the seam are known, with the ranks at which the next merge uses them up. A
        merge across the seam wins if it comes before both; at equal rank the leftmost wins.
        """
        rank, halves = self.rank, self.halves
        left_used = right_used = inf
        while True:
            across = rank.get(left + right)
            if across is not None and across < left_used and across <= right_used:
                return False
            left_made = rank[left] if len(left) > 1 else -inf
            right_made = rank[right] if len(right) > 1 else -inf
            if left_made == right_made == -inf:
                return True
            if left_made > right_made:
                left_used, left = left_made, halves[left][1]
            else:
                right_used, right = right_made, halves[right][0]

    def _make_tables(self) -> None:
        """Automaton and merge tables as arrays, for many parts at a time."""
        pieces = list(self.automaton.keys())
        common = Counter(c for p in pieces for c in set(p) if ord(c) < 0x3000).most_common(ALPHABET)
        self.class_of = np.zeros(0x3001, np.uint8)
        for k, (c, _) in enumerate(common):
            self.class_of[ord(c)] = k + 1
        self.tabled = frozenset(c for c, _ in common)
        children: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for p in pieces:
            node = 0
            for c in p:
                step = (node, int(self.class_of[min(ord(c), 0x3000)]))
                if not step[1]:
                    break
                if step not in children:
                    children[step] = len(piece_at)
                    piece_at.append(-1)
                node = children[step]
            else:
                piece_at[node] = self.id[p]
        self.next_node = np.zeros((len(piece_at), ALPHABET + 1), np.int32)
        at = np.array(list(children), np.int64)
        self.next_node[at[:, 0], at[:, 1]] = list(children.values())
        self.piece_at = np.array(piece_at, np.int32)
        size = len(self.piece)
        self.made = np.full(size, -np.inf)
        self.left_half, self.right_half = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for p, (left, right) in self.halves.items():
            i = self.id[p]
            self.made[i], self.left_half[i], self.right_half[i] = self.rank[p], self.id[left], self.id[right]
        across = sorted(
            (self.id[p[:k]] << ID_BITS | self.id[p[k:]], r)
            for p, r in self.rank.items()
            for k in range(1, len(p))
            if p[:k] in self.id and p[k:] in self.id
        )
        self.seams = np.array([a for a, _ in across] or [-1], np.int64)
        self.seam_ranks = np.array([r for _, r in across] or [np.inf])
        self.slot_pair = np.full(PAIR_SLOTS, -1, np.int64)
        self.slot_answer = np.zeros(PAIR_SLOTS, bool)

    def _test_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``stay_apart`` for arrays of piece ids."""
        answer = np.ones(len(left), bool)
        active = np.arange(len(left))
        left_used, right_used = np.full(len(left), np.inf), np.full(len(left), np.inf)
        while len(active):
            key = left << ID_BITS | right
            at = np.minimum(np.searchsorted(self.seams, key), len(self.seams) - 1)
            across = np.where(self.seams[at] == key, self.seam_ranks[at], np.inf)
            merged = (across < left_used) & (across <= right_used) & (across < np.inf)
            answer[active[merged]] = False
            left_made, right_made = self.made[left], self.made[right]
            go = ~merged & ((left_made > -np.inf) | (right_made > -np.inf))
            undo_left = left_made > right_made
            left_used, right_used = np.where(undo_left, left_made, left_used), np.where(undo_left, right_used, right_made)
            left, right = np.where(undo_left, self.right_half[left], left), np.where(undo_left, right, self.left_half[right])
            active, left, right, left_used, right_used = (x[go] for x in (active, left, right, left_used, right_used))
        return answer

    def _pairs_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_test_pairs`` with remembered answers."""
        key = left << ID_BITS | right
        slot = (mix(key.view(np.uint64)) % np.uint64(PAIR_SLOTS)).astype(np.int64)
        answer = self.slot_answer[slot]
        new = np.flatnonzero(self.slot_pair[slot] != key)
        if len(new):
            fresh, where = np.unique(key[new], return_inverse=True)
            found = self._test_pairs(fresh >> ID_BITS, fresh & ((1 << ID_BITS) - 1))
            answer[new] = found[where]
            self.slot_pair[slot[new]], self.slot_answer[slot[new]] = key[new], answer[new]
            # Where two pairs share a slot, the last one written holds it; both arrays keep the same one.
        return answer

    def _many(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as the bytes of 32-bit numbers. All characters must be in the automaton's table."""
        lengths = np.array([len(p) for p in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        classes = self.class_of[np.minimum(codes, 0x3000)]
        n = len(codes)
        begins = np.cumsum(lengths) - lengths
        place = np.arange(n) - np.repeat(begins, lengths)
        left_over = np.repeat(lengths, lengths) - place
        # Automaton: from every place, step through the pieces that begin there.
        at, node, ends, sizes, ids = np.arange(n), np.zeros(n, np.int32), [], [], []
        step = 0
        while len(at):
            node = self.next_node[node, classes[at + step]]
            alive = node > 0
            at, node = at[alive], node[alive]
            piece = self.piece_at[node]
            hit = piece >= 0
            ends.append(at[hit] + step)
            sizes.append(np.full(len(ends[-1]), step + 1))
            ids.append(piece[hit].astype(np.int64))
            step += 1
            more = left_over[at] > step
            at, node = at[more], node[more]
        end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(ids)
        order = np.argsort(place[end], kind="stable")
        end, size, piece = end[order], size[order], piece[order]
        bounds = np.searchsorted(place[end], np.arange(lengths.max() + 1))
        # Prefix table, one place of all parts at a time.
        last, last_size = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for k in range(lengths.max()):
            low, high = bounds[k], bounds[k + 1]
            e, z, p = end[low:high], size[low:high], piece[low:high]
            good = z == k + 1
            rest = np.flatnonzero(~good)
            good[rest] = self._pairs_fit(last[e[rest] - z[rest]], p[rest])
            last[e[good]], last_size[e[good]] = p[good], z[good]
        # Backwards: the places where a piece of the encoding ends.
        used = np.zeros(n, bool)
        at, first = begins + lengths - 1, begins
        while len(at):
            used[at] = True
            at = at - last_size[at]
            more = at >= first
            at, first = at[more], first[more]
        cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(used, begins, dtype=np.int64))]).tolist()
        found = last[used].astype(np.int32).tobytes()
        return [found[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _known_run(self, run: str) -> list[int]:
        """Ids of one run of characters that are all in the vocabulary."""
        last, size_at = [""] * len(run), [0] * len(run)
        for end, (i, size) in self.automaton.iter(run):
            if not size_at[end] and (size > end or self.stay_apart(last[end - size], self.piece[i])):
                last[end], size_at[end] = self.piece[i], size
        ids, at = [], len(run) - 1
        while at >= 0:
            ids.append(self.id[last[at]])
            at -= size_at[at]
        ids.reverse()
        return ids

    def _part(self, part: str) -> list[int]:
        if self.characters.issuperset(part):
            return self._known_run(part)
        ids: list[int] = []
        for known, run in groupby(part, self.characters.__contains__):
            if known:
                ids += self._known_run("".join(run))
            else:
                ids += [self.byte_ids[b] for b in "".join(run).encode("utf-8")]
        return ids

    def _learn(self, parts: set[str]) -> None:
        """Remember the ids of parts."""
        known, before = self.known, self.known_before
        short, long = [], []
        for p in parts:
            ids = before.get(p)
            if ids is not None:
                known[p] = ids
            elif len(p) <= REMEMBERED_LENGTH and self.tabled.issuperset(p):
                short.append(p)
            else:
                long.append(p)
        if short:
            known.update(zip(short, self._many(short), strict=True))
        for p in long:
            known[p] = np.array(self._part(p), np.int32).tobytes()

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        cut = [self.parts((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        found = [list(map(self.known.get, parts)) for parts in cut]
        new = {p for parts, ids in zip(cut, found, strict=True) if None in ids for p, i in zip(parts, ids, strict=True) if i is None}
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known_before, self.known = self.known, {}
                new = set(chain.from_iterable(cut))
            self._learn(new)
            get = self.known.__getitem__
            found = [list(map(get, parts)) if None in ids else ids for parts, ids in zip(cut, found, strict=True)]
        return [np.frombuffer(b"".join(ids), np.int32).tolist() for ids in found]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def written(self, ids: list[int]) -> str:
        """Ids as decimals, joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    """One codec for each Python worker; the vocabulary file lies at the same path on every machine."""
    return Codec(model_path)


def encode_and_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text, and the text that they decode to: key, ids, decoded.

    Null and empty texts have no ids and decode to the empty text. Rows keep their number and
    order, repeated rows included; a null key stays null. Other columns are not looked at.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        ids = c.encode_many(texts_of(batch, "_text"))
        return batch_of(
            **{key: column_of(batch, "_key")},
            ids=pa.array(ids, pa.list_(pa.int32())),
            decoded=pa.array([c.decode(i) for i in ids], pa.string()),
        )

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    return map_slices(rows, "_text", run, f"`{key}` {kind}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, SHA-256 of the ids (decimal, comma-joined) and of the decoded text.

    The same rows as ``encode_and_decode``, digested where they are made, so that the ids do not
    travel; null and empty texts have the digests of the empty text.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        counts, id_digests, text_digests = [], [], []
        for ids in c.encode_many(texts_of(batch, "_text")):
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(c.written(ids).encode()).hexdigest())
            text_digests.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return batch_of(
            **{key: column_of(batch, "_key")},
            n_tokens=pa.array(counts, pa.int64()),
            ids_sha256=pa.array(id_digests, pa.string()),
            decoded_sha256=pa.array(text_digests, pa.string()),
        )

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_slices(rows, "_text", run, schema)
