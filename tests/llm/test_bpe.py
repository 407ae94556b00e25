"""BPE: equal to the tokenizers library on whole texts, whatever the cuts."""

import hashlib
import random
import string

import numpy as np
import pytest

from airsignal.llm import bpe
from airsignal.llm.queries import vocabulary_path
from tests.llm.conftest import EDGES


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe._unpack(bpe._pack(bpe.vocabulary(vocabulary_path()))))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_tree_equals_library(codec, library):
    rnd = random.Random(1)
    alphabets = [string.ascii_letters, string.ascii_letters + string.digits + "+/", "ab", "a", " \n\t", string.printable,
                 "日本語テスト中文字符", "éàü'sßt're ", "'s", "🎉👍🏽é ", "　  x"]
    for _ in range(60):
        s = ""
        for _ in range(rnd.randint(1, 4)):
            a = rnd.choice(alphabets)
            s += "".join(rnd.choice(a) for _ in range(rnd.choice([3, 50, 1500, 4000]))) + ("<|endoftext|>" if rnd.random() < 0.3 else "")
        expected = library.encode(s, add_special_tokens=False).ids
        assert codec.encode(s).tolist() == expected
        parts = list(codec.pieces(s, 700))
        assert "".join(t for t, _, _ in parts) == s
        assert codec.collect((codec.leaf(t, raw), joins) for t, joins, raw in parts).tolist() == expected
        assert codec.decode(np.array(expected, np.uint32)) == library.decode(expected, skip_special_tokens=False)


def test_windows_grow(codec):
    """A join whose first window does not agree: runs in which a merge far away decides."""
    run = b"a" * 5000
    whole = codec.run(run)
    for cut in (1, 2, 3, 7, 1000, 2501, 4999):
        a, b = (np.asarray(codec.run(x), np.uint32) for x in (run[:cut], run[cut:]))
        assert codec.join(a, b).tolist() == whole


def test_operator_on_edges(edges, library):
    rows = bpe.encode_digest(edges, vocabulary_path()).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for i, t, _ in EDGES:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_round_trip(edges, empty):
    back = bpe.decode(bpe.encode(edges, vocabulary_path()), vocabulary_path()).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in EDGES)
    assert bpe.encode(empty, vocabulary_path()).count() == 0
