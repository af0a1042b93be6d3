"""What a stage of a pipeline leaves in a Python worker."""

import numpy as np
import public_tokenizers

from rasterloom.llm import bpe_stream, common, minhash, suffix_dedup
from rasterloom.llm.blocks import Block


def remembered(make):
    common._MEMOS.clear()
    make()
    assert common._MEMOS


def test_another_memo_takes_the_place_of_the_last():
    remembered(lambda: minhash.shingle_set(b"some words of a text"))
    bpe_stream.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert list(common._MEMOS) == [("bpe", public_tokenizers.path("word_bpe_49k.json"))]
    kept = bpe_stream.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert kept is bpe_stream.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    minhash.shingle_set(b"some words of a text")
    assert list(common._MEMOS) == ["word-hash"]
    common._MEMOS.clear()


def test_suffix_steps_drop_what_other_operators_remember():
    text = b"The same passage of more than fifty bytes stands twice here. " * 2
    block = Block(0, np.array([1]), np.array([len(text)]), text)
    for step in (lambda: list(suffix_dedup._seen(50)(block, [], 3)), lambda: list(suffix_dedup._send(50)(block, [], 3)), lambda: list(suffix_dedup._decide(50)([])), lambda: list(suffix_dedup._kept(True)(block, []))):
        remembered(lambda: minhash.shingle_set(text))
        step()
        assert not common._MEMOS


def test_segments_do_not_change_what_is_removed(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 100, 6000, dtype=np.uint8))
    block = Block(0, np.array([1, 2]), np.array([3000, 3000]), text[:3000] + text[200:2000] + text[4000:5200])
    found = []
    for size in (1 << 18, 1000):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", size)
        first, count, _ = suffix_dedup._fragments(block, 50)
        assert np.array_equal(np.sort(np.concatenate([np.arange(f, f + c) for f, c in zip(first, count, strict=True)])), np.r_[0:2951, 3000:5951])
        told = [d for _, kind, d in suffix_dedup._seen(50)(block, [], 1) if kind == 1]
        sent = list(suffix_dedup._send(50)(block, told, 1))
        gone = [d for _, kind, d in sent if kind == 1] + [d for _, d in suffix_dedup._decide(50)([(0, d) for _, kind, d in sent if kind == 0])]
        found.append(list(suffix_dedup._kept(True)(block, gone)))
    left, right = block.text[:3000], block.text[3000:]
    starts = {left[i : i + 50] for i in range(2951)}
    gone = {j for i in range(2951) if right[i : i + 50] in starts for j in range(i, i + 50)}
    assert found[0] == found[1] and found[0][1][2] == len(gone) >= 1800
