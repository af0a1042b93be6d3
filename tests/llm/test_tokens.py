import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from text_data import pairs
from tokenizers import Tokenizer as Library

from rasterloom.llm import bpe_stream, token_files
from rasterloom.llm.common import Memo

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("abcdeimnorstthe'ZÀéΣςİß12 \t\n\x1c\x85 é!,.#<|日本̈🙂")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe_stream.Tokenizer(PATH)


def texts(n=150):
    r = random.Random(5)
    odd = ["", " ", "<|startoftext|>hello<|endoftext|>X", "a" * 5000, "ab" * 3000, "!" * 3000, "ΑΣ, ΑΣ. İ. x", "thethere" * 300 + "don't'll'S"]
    return odd + ["".join(r.choices(ALPHABET, k=r.randint(0, 300))) for _ in range(n)] + ["".join(r.choices("thearino", k=1500)) for _ in range(5)]


def test_own_encoding_and_decoding_equal_the_library(library, own):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(t), "<u4").tolist()
        assert got == want
        d = bpe_stream.Decoder(own)
        assert d.feed(got[:3]) + d.feed(got[3:]) + d.finish() == library.decode(want, skip_special_tokens=False)


def test_letters_that_python_does_not_know(library, own):
    """Every fifth code point, among them those that are unassigned for Python and letters for the library."""
    enc, unknown = token_files.LibraryEncoder(PATH), 0
    points = [0x1C89, 0xA7CB, 0xA7DA, 0x208F, 0x0558, 0x323C0, *(c for c in range(0, 0x33480, 5) if not 0xD800 <= c < 0xE000)]
    words = [f"a{chr(c)}b. {chr(c)}" for c in points]
    flat, at = enc.encode(pa.array(words))
    for c, text, e, lo, hi in zip(points, words, library.encode_batch(words, add_special_tokens=False), at[:-1], at[1:], strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == e.ids == flat[lo:hi].tolist(), hex(c)
        unknown += unicodedata.category(chr(c)) == "Cn"
    assert unknown > 1000


def test_transducer_emits_early_and_keeps_little(own):
    r = random.Random(1)
    for letters in ("thearino", "ab", "ing"):
        s = r.choices(letters, k=2000)
        machine, out, most = bpe_stream.Transducer(own.table, 1), [], 0
        for c in s:
            out += machine.push([c])
            most = max(most, len(machine.tail))
        assert most <= own.table.lookahead + 40
        assert out + list(machine.finish()) == own.table.reduce(s)


def test_lookahead_and_improper_lists():
    table = bpe_stream.MergeTable({"a": 0, "b": 1, "ab": 2, "abab": 3}, [("a", "b"), ("ab", "ab")])
    assert table.encode(list("ababab")) == table.reduce(list("ababab")) == ["abab", "ab"]
    assert table.lookahead >= 2
    with pytest.raises(ValueError):
        bpe_stream.MergeTable({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_decoder_joins_bytes_across_tokens(own):
    ids = np.frombuffer(own.encode("日本 żółć"), "<u4").tolist()
    d = bpe_stream.Decoder(own, "bytes")
    assert "".join([*(d.feed([i]) for i in ids), d.finish()]) == "日本 żółć "


def test_encode_documents(spark, library, odd):
    got = bpe_stream.encode_documents(odd, PATH).collect()
    assert len(got) == odd.count()
    want = sorted((i is None, i or 0, hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t in pairs(odd))
    assert sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(r.ids).hexdigest()) for r in got) == want
    assert bpe_stream.encode_documents(odd.limit(0), PATH).count() == 0


def test_library_encoder(library):
    enc = token_files.LibraryEncoder(PATH, size=50)
    t = texts()
    for at in range(0, len(t), 20):
        flat, ends = enc.encode(pa.array(t[at : at + 20]))
        for text, lo, hi in zip(t[at : at + 20], ends[:-1], ends[1:], strict=True):
            assert flat[lo:hi].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, library, odd, folder):
    manifest = token_files.write_tokens(odd, folder, PATH, end_id=1, length=16, rows=4)
    got = sorted(token_files.read_documents(spark, manifest).collect(), key=lambda r: r.start)
    rows = sorted((-(2**63) if i is None else i, (t or "").encode()) for i, t in pairs(odd))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = np.array([*library.encode(t.decode(), add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id if r.doc_id is not None else -(2**63), r.start, r.n_tokens, zlib.crc32(r.ids)) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_documents(spark, token_files.write_tokens(odd.limit(0), folder, PATH)).count() == 0


def test_shard_gives_views_and_masks(folder):
    w = token_files.ShardWriter(folder, "<u2", 8, 2, 9)
    for i in range(5):
        w.add(i, np.full(5, i, "<u2"))
    w.close()
    s = token_files.Shard(f"{folder}/{w.name}")
    ids, mask = s.sequence(3)
    assert ids.tolist() == [4, 9, 9, 9, 9, 9, 9, 9] and mask.to_pylist() == [True] + [False] * 7
    assert not ids.flags.owndata
    assert s.tokens(5, 5).tolist() == [1] * 5 and s.tokens(12, 9).tolist() == [2] * 3 + [3] * 5 + [4]
    assert list(s.documents()) == [(i, 5 * i, 5) for i in range(5)]


def test_memo_is_bounded():
    m = Memo(lambda k: k * 2, 3)
    assert [m[str(i)] for i in range(20)] == [str(i) * 2 for i in range(20)]
    assert len(m) + len(m.old) <= 6
