import numpy as np
import pytest
from text_data import pairs, with_low_id  # noqa: F401

import brute
from rasterloom.llm import blocks, graph, minhash, substring_dedup, suffix_dedup


def low(rows, *at):
    return sorted(tuple(-(2**63) if v is None and k in at else v for k, v in enumerate(r)) for r in rows)


def test_two_stage_suffix_array(rng):
    for n, letters, depth in ((0, 2, 5), (1, 2, 5), (300, 2, 20), (2000, 4, 12), (500, 256, 3)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        wanted = np.sort(rng.choice(n, n // 2, replace=False)) if n else np.empty(0, np.int64)
        order = suffix_dedup.two_stage_suffix_array(text, wanted, depth)
        assert sorted(order) == sorted(wanted)
        keys = [bytes(text[i : i + depth]) for i in order]
        assert keys == sorted(keys)


def test_common_prefixes(rng):
    text = np.concatenate([rng.integers(0, 2, 500), np.zeros(70)]).astype(np.uint8)
    wanted = np.arange(500)
    order = suffix_dedup.two_stage_suffix_array(text, wanted, 9)
    for depth in (1, 5, 8, 9, 17):
        found = suffix_dedup.adjacent_common_prefixes(text, order, depth)
        want = [next((k for k in range(depth) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]), depth) for a, b in zip(order[:-1], order[1:], strict=True)]
        assert found.tolist() == want


@pytest.mark.parametrize("size", [300, 2 << 20])
def test_suffix_dedup_equals_brute_force(spark, sample, odd, size, monkeypatch):
    monkeypatch.setattr(blocks.make_blocks, "__defaults__", ("doc_id", "text", size, None))
    docs = sample.where("doc_id < 90").select("doc_id", "text")
    got = suffix_dedup.remove_repeats(docs, digest=True)
    assert low(got.collect()) == brute.suffix_dedup(pairs(docs))
    few = odd.where("doc_id IS NULL OR doc_id NOT IN (7, 8)")
    assert low(suffix_dedup.remove_repeats(few, digest=True).collect(), 0) == brute.suffix_dedup(with_low_id(pairs(few)))


def test_suffix_dedup_length_and_empty(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz0123456789"), (2, "__abcdefghijklmnopqrstuvwxyz0123"), (3, None)], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(docs, length=25).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in rows] == [b"abcdefghijklmnopqrstuvwxyz0123456789", b"__", b""]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, length=10)


def test_cut_texts_keeps_every_column(odd):
    out = suffix_dedup.cut_texts(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    assert all(r.score == "clash" for r in rows.values())
    assert all(r.text == "" for r in out.where("doc_id = 2 AND length(text) = 0").collect())


@pytest.mark.parametrize("size", [300, 2 << 20])
def test_substring_dedup_equals_brute_force(spark, sample, odd, size, monkeypatch):
    monkeypatch.setattr(blocks.make_blocks, "__defaults__", ("doc_id", "text", size, None))
    docs = sample.select("doc_id", "text")
    assert low(substring_dedup.remove_repeats(docs, digest=True).collect()) == brute.substring_dedup(pairs(docs))
    assert low(substring_dedup.remove_repeats(odd, digest=True).collect(), 0) == brute.substring_dedup(with_low_id(pairs(odd)))
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_connected_components(spark, rng):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (250, 300)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_needed_overlap_is_safe(rng):
    k = 64
    for n in (1, 3, 20, 54, 60, 64, 70, 100, 400, 5000):
        least = minhash.needed_overlap(n, k, 0.85)
        for _ in range(30):
            both = int(np.ceil(0.85 * n / 0.925))  # two sets of n with similarity 0.85
            h = rng.integers(0, 2**63, 2 * n - both, dtype=np.int64)
            if 100 * both < 85 * len(h):
                continue
            a, b = np.sort(h[:n])[:k], np.sort(np.r_[h[:both], h[n:]])[:k]
            assert len(np.intersect1d(a, b)) >= least


def test_near_duplicates_equal_brute_force(spark, sample, odd):
    docs = sample.select("doc_id", "text")
    assert low(minhash.near_duplicates(docs).collect()) == brute.near_duplicates(pairs(docs))
    few = odd.where("doc_id IS NULL OR doc_id <> 2")
    got = low(minhash.near_duplicates(few).collect(), 0, 2)
    assert got == brute.near_duplicates(with_low_id(pairs(few)))
    # an id with two texts is one document
    two = {r.component_id for r in minhash.near_duplicates(odd).where("doc_id IN (1, 2)").collect()}
    assert len(two) == 1
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [200_000, 2_000])
def test_near_duplicates_in_long_lists(spark, rng, block, monkeypatch):
    """A large group of different near copies, and unrelated texts with one common passage."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CELLS", block)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 90)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(90, i % 3, replace=False):
            w[p] = f"x{i}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(1000 + i, common + " " + " ".join(f"u{i}_{j}" for j in range(11 + i % 9))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert low(minhash.near_duplicates(docs).collect()) == brute.near_duplicates(rows)
