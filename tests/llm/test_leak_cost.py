"""What the search for leaks does only once."""

import numpy as np
import pyarrow as pa

from rasterloom.llm import decontaminate


def test_distinct_words_are_hashed_once(monkeypatch):
    seen = []
    plain = decontaminate.hash_words
    monkeypatch.setattr(decontaminate, "hash_words", lambda words: seen.append(len(words)) or plain(words))
    texts = ["A word, a WORD ... (word)\n\x1c é É é.  x " * 50, "", "--", "word"]
    flat, at = decontaminate._hashes_of(pa.array([t.encode() for t in texts], pa.binary()))
    assert sum(seen) < 20
    assert at.tolist()[1:4] == [at[1]] * 3 and at[4] == at[1] + 1 and len(flat) == at[4]
    one = [decontaminate.word_hashes(w.encode())[0] for w in ("a", "word", "a", "word", "word")]
    assert flat[:5].tolist() == one and flat[-1] == one[1] and flat.all()
    assert flat[6] == flat[7] == flat[8]


def test_the_table_of_axes_lies_row_by_row():
    axes = np.asfortranarray(np.arange(12, dtype=np.float32).reshape(4, 3))
    table = decontaminate._table(decontaminate.Space(np.ones(4, np.float32), axes, np.ones(3)))
    assert table.flags.c_contiguous and np.array_equal(table, np.vstack([axes, np.zeros((1, 3))]))
