"""Quality network: word vectors and pooling against plain loops, gradients
against differences, and held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from rasterloom.llm import quality_net as qn
from text_data import pairs

TEXTS = ["The cat sat, the cat ran.", "", None, " \n\t", "one", "The The The The", "Ünïcödé ### wörds | ünd\x0bmore " * 3, "x" * 700 + " end", "  lead and trail  "]


def words(text):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")


def column():
    return pa.array([(t or "").encode() for t in TEXTS], pa.binary())


def of(word):
    """Vectors of one word alone."""
    one = pa.array([word])
    return qn.forms(one)[0], *(x[0] for x in qn.buckets(one))


def signs(code, width):
    v = np.zeros(width)
    for k in range(qn.SIGNS):
        part = int(code) >> 16 * k
        v[(part >> 1) % width] += 1 - 2 * (part & 1)
    return v


def test_words_and_their_vectors_do_not_depend_on_company():
    distinct, codes, at = qn.split(column())
    plain = [[w for w in words(t) if w] for t in TEXTS]
    known = distinct.to_pylist()
    assert [[known[c] for c in codes[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)] == plain
    together = qn.forms(distinct), *qn.buckets(distinct)
    for k, w in enumerate(known):
        form, bucket, code = of(w)
        assert np.allclose(form, together[0][k], atol=1e-6) and bucket == together[1][k] and code == together[2][k]
        assert abs(np.linalg.norm(form) - 1) < 1e-5


def test_uses_sum_the_neighbours():
    distinct, codes, at = qn.split(column())
    found = qn.uses(distinct, codes, at)
    plain = np.zeros_like(found)
    for t in TEXTS:
        ws = [w for w in words(t) if w]
        for i, w in enumerate(ws):
            row = of(w)[1]
            plain[row, -1] += 1
            for j in range(max(0, i - qn.WINDOW), min(len(ws), i + qn.WINDOW + 1)):
                if j != i:
                    plain[row, :-1] += signs(of(ws[j])[2], qn.USE)
    assert np.array_equal(found, plain)


@pytest.mark.parametrize("step", [1, 2, 5, 50_000])
def test_pooling(monkeypatch, step, rng):
    monkeypatch.setattr(qn, "STEP", step)
    table = rng.normal(size=(qn.BUCKETS, qn.USE)).astype(np.float32)
    found = qn.pooled(column(), table)
    for t, row in zip(TEXTS, found, strict=True):
        ws = [w for w in words(t) if w]
        want = np.zeros(qn.POOLED)
        if ws:
            v = np.array([np.r_[of(w)[0], table[of(w)[1]]] for w in ws], float)
            n = qn.FORM + qn.USE
            want[:n], want[n : 2 * n] = v.mean(0), v.std(0)
            for g in (1, 2):
                want[2 * n + g - 1] = sum(v[i, : qn.FORM] @ v[i + g, : qn.FORM] for i in range(len(ws) - g)) / max(1, len(ws) - g)
            want[-1] = np.log1p(len(ws))
        assert np.allclose(row, want, atol=1e-3)


def test_gradients(rng):
    z, y = rng.normal(size=(20, 7)), (rng.random(20) < 0.5).astype(float)
    net = qn.Network(np.zeros(7), np.ones(7), rng.normal(size=(7, 4)), rng.normal(size=4), rng.normal(size=4), 0.3)

    def loss():
        p = np.maximum(0, z @ net.w1 + net.b1) @ net.w2 + net.b2
        return (np.logaddexp(0, p) - y * p).mean() + 0.05 * ((net.w1**2).sum() + (net.w2**2).sum())

    g = qn.gradients(net, z, y, 0.1)
    for name, part in zip(("w1", "b1", "w2"), g, strict=False):
        w = getattr(net, name)
        for at in np.ndindex(w.shape):
            old, e = w[at], 1e-6
            w[at] = old + e
            up = loss()
            w[at] = old - e
            assert abs((up - loss()) / (2 * e) - part[at]) < 1e-6
            w[at] = old


def test_temperature_makes_odds_right(rng):
    true = rng.normal(size=40_000) * 2
    y = (rng.random(40_000) < 1 / (1 + np.exp(-true))).astype(float)
    assert abs(qn.temperature(true * 3, y) - 3) < 0.15
    assert 0.1 < qn.temperature(np.array([9.0, -9.0]), np.array([1.0, 0.0])) < 100


def test_word_table_is_summed_over_all_partitions(spark, sample):
    whole = pa.array([(t or "").encode() for _, t in pairs(sample)], pa.binary())
    want = qn.directions(qn.uses(*qn.split(whole)))
    assert np.allclose(qn.word_table(sample.repartition(7)), want, atol=1e-5)
    assert qn.word_table(sample.limit(0)).shape == want.shape


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    table = qn.word_table(docs)
    scored = qn.score_documents(docs, table, qn.fit(docs, labels, table)).withColumn("fold", qn.fold(qn.F.col("doc_id"))).join(labels, "doc_id").collect()
    held = [r for r in scored if r["fold"] == 2]
    assert len(held) > 80 and sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    loss = -np.mean([np.log(r["score"] if r["quality"] else 1 - r["score"]) for r in held])
    assert loss < 0.2


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (99, 1), (7, 1), (12, 0), (13, 0)], "doc_id long, quality int")
    table = qn.word_table(odd)
    net = qn.fit(odd, labels, table)
    out = qn.score_documents(odd, table, net).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    same = {(r["doc_id"]): r["score"] for r in out}
    assert same[4] == same[5] == same[6]
    empty = odd.limit(0)
    t = qn.word_table(empty)
    assert qn.score_documents(empty, t, qn.fit(empty, labels, t)).count() == 0
    none = qn.train(np.zeros((3, qn.POOLED)), np.ones(3, int))
    assert np.allclose(none.score(np.ones((2, qn.POOLED))), 0.8)
