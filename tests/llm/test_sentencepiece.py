import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.conftest import ODD_PAIRS
from veilframe.llm.sentencepiece_codec import codec, encode_and_decode, round_trip_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_matches_the_library_on_built_texts(library):
    c, rng = codec(MODEL), random.Random(3)
    pieces = list(c.rank)
    odd = "aab  \n\tthe▁<s>0x0A☃é中文\x00　ﬁＡ😀"
    texts = ["", " ", "\n", "▁", "<s>", "<0x0A>"]
    for _ in range(1500):
        texts.append("".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))).replace("▁", " "))
        texts.append("".join(rng.choice(odd) for _ in range(rng.randint(1, 30))))
        texts.append("".join(rng.choice("ab") for _ in range(rng.randint(1, 60))))
    texts += [a + " " * k + b for k in range(80) for a in ("", "x") for b in ("", "the", "\n", ".")]
    assert c.encode_many(texts) == library.encode(texts)


def test_pairs_agree_with_merging_them(library):
    c, rng = codec(MODEL), random.Random(4)
    pieces = [p for p in c.halves if "▁" not in p[1:]]
    for _ in range(3000):
        a, b = rng.choice(pieces), rng.choice(pieces).lstrip("▁")
        if b not in c.halves:
            continue
        symbols = list(a + b)
        while True:
            ranked = [(c.rank[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in c.rank]
            if not ranked:
                break
            k = min(ranked)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        assert c.stay_apart(a, b) == (symbols == [a, b])


def test_documents(documents, plain, library):
    rows = round_trip_digests(documents, MODEL).collect()
    assert len(rows) == len(plain)
    for r in rows:
        ids = library.encode(plain[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, nothing, library):
    rows = encode_and_decode(odd, MODEL).collect()
    expected = sorted((str(i), library.encode(t or "")) for i, t in ODD_PAIRS)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == expected
    assert all(r["decoded"] == library.decode(r["ids"]) for r in rows)
    assert encode_and_decode(nothing, MODEL).count() == 0
    assert round_trip_digests(nothing, MODEL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
