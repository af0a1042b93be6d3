"""Short words need no streaming machine, long ones do."""

import numpy as np
import public_tokenizers

from rasterloom.llm import bpe_stream


def test_short_words_are_split_at_once(monkeypatch):
    t = bpe_stream.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghinorstu"), int(k))) for k in rng.integers(1, 40, 300)] + ["the", "a", "ß", "über"]
    pushed = []
    push = bpe_stream.Transducer.push
    monkeypatch.setattr(bpe_stream.Transducer, "push", lambda self, symbols: pushed.append(1) or push(self, symbols))
    for word in words:
        symbols = [t.symbols[b] for b in word.encode()]
        symbols[-1] += bpe_stream.END
        want = [t.table.vocab[x] for x in t.table.reduce(symbols)]
        assert np.frombuffer(t.encode(word), "<u4").tolist() == want
    assert not pushed  # a short word is split at once, not symbol by symbol
    long = "".join(rng.choice(list("abcdefghinorstu"), 500))
    symbols = [*long[:-1], long[-1] + bpe_stream.END]
    assert np.frombuffer(t.encode(long), "<u4").tolist() == [t.table.vocab[x] for x in t.table.reduce(symbols)] and pushed
