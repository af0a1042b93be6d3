"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability
sigmoid(bias + weights of its words); a document is toxic unless none of its
sentences is (noisy-or). The sentence model is trained from document labels
alone, through the noisy-or, and then names the sentences that offend.

A word's weight is the sum of the weights of the word and of its prefixes, so
inflected forms share what is learned.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, documents, forget, give_back, id_out

PREFIXES = (4, 5, 6)
STRIP = ".,;:!?()[]{}\"'`«»„“”…-*_"
ENDS = (".", "!", "?", "…")
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*")
_FLAG = 1000.0  # added to a word's weight if the word ends its sentence


def features(word: str) -> list[str]:
    w = word.strip(STRIP).lower()
    return [w, *(f"{w[:n]}*" for n in PREFIXES if len(w) >= n)] if w else []


def words_of(text: str) -> list[str]:
    """White-space-separated words; a line end is a word "." of its own."""
    return text.replace("\n", " . ").split()


def fold(id_col) -> F.Column:
    """crc32 of the id as text, modulo 3. Rows of fold 1 are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


@dataclass
class Model:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.value = Memo(self._value, 100_000)

    def _value(self, word: str) -> float:
        get = self.model.weights.get
        total = sum(get(f, 0.0) for f in features(word))
        return max(-400.0, min(400.0, total)) + (_FLAG if word.endswith(ENDS) else 0.0)

    def score(self, text: str) -> float:
        """Noisy-or over the sentences of a whole text; 0 for one without words."""
        words = words_of(text)
        if not words:
            return 0.0
        v = np.fromiter(map(self.value.__getitem__, words), np.float64, len(words))
        end = v > _FLAG / 2
        v[end] -= _FLAG
        starts = np.r_[0, np.flatnonzero(end[:-1]) + 1]
        z = np.add.reduceat(v, starts) + self.model.bias
        # log(1 - p) of a sentence is -log(1 + exp(z))
        return float(-np.expm1(-np.logaddexp(0.0, z).sum()))

    def sentences(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of offending sentences, in characters."""
        out = []
        for m in _SENTENCE.finditer(text):
            v = sum(self.value[w] - (_FLAG if w.endswith(ENDS) else 0.0) for w in m[0].split())
            p = float(1 / (1 + np.exp(-np.clip(v + self.model.bias, -500, 500))))
            if p >= least and m[0].strip():
                out.append((m.start(), m.end(), p))
        return out


class _Fit:
    """Weights with the state of their optimiser (Adam, with an L1 step)."""

    def __init__(self, y: np.ndarray, n_features: int, n_words: int, l1: float):
        self.y, self.n_words, self.l1, self.step = y, n_words, l1, 0
        self.w, self.b = np.zeros(n_features), -3.0
        self.m, self.v, self.mb, self.vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
        self.balance = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def narrow(self, left: np.ndarray, n_words: int) -> None:
        """Go on with some of the features only."""
        self.w, self.m, self.v, self.n_words = self.w[left], self.m[left], self.v[left], n_words

    def run(self, epochs: int, rate: float, word, bag, doc, plain, pw, pf) -> None:
        """word, bag: words of sentences; doc: document of each sentence; plain:
        sentences per document without any weight; pw, pf: features of words."""
        n = len(self.y)
        for _ in range(epochs):
            self.step += 1
            u = np.bincount(pw, self.w[pf], minlength=self.n_words)
            z = np.bincount(bag, u[word], minlength=len(doc)) + self.b
            none = np.bincount(doc, np.logaddexp(0.0, z), minlength=n) + plain * np.logaddexp(0.0, self.b)  # -log P(no toxic sentence)
            pull = np.where(self.y, -1 / np.expm1(np.clip(none, 1e-6, 500)), 1.0) * self.balance
            g = pull[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
            gw = np.bincount(pf, np.bincount(word, g[bag], minlength=self.n_words)[pw], minlength=len(self.w))
            gb = g.sum() + (pull * plain).sum() / (1 + np.exp(-self.b))
            self.m, self.v = 0.9 * self.m + 0.1 * gw, 0.99 * self.v + 0.01 * gw**2
            self.mb, self.vb = 0.9 * self.mb + 0.1 * gb, 0.99 * self.vb + 0.01 * gb**2
            rise, fall = 1 - 0.9**self.step, 1 - 0.99**self.step
            size = rate / (np.sqrt(self.v / fall) + 1e-6)
            self.w -= size * self.m / rise
            self.w = np.sign(self.w) * np.maximum(0.0, np.abs(self.w) - np.minimum(size * self.l1, 0.2))
            self.b -= rate * self.mb / rise / (np.sqrt(self.vb / fall) + 1e-6)


def train(texts: list[str], labels: list[int], epochs: int = 40, rate: float = 0.1, l1: float = 1e-4, least: int = 4) -> Model:
    """Fit by full-batch gradients on the noisy-or likelihood: `epochs` over everything, then more over the features that are
    left. Features seen in fewer than `least` documents are left out.
    Without both labels the model answers 0 or 1 for every text with words."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return Model(20.0 if len(y) and y.all() else -20.0)
    number: dict[str, int] = {}
    ids, lengths, sentence_doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        held = len(ids)
        for w in words_of(text):
            ids.append(number.setdefault(w, len(number)))
            if w.endswith(ENDS):
                lengths.append(len(ids) - held)
                sentence_doc.append(d)
                held = len(ids)
        if len(ids) > held:
            lengths.append(len(ids) - held)
            sentence_doc.append(d)
    if not ids:
        return Model(-20.0)
    word, doc = np.frombuffer(ids, np.int32), np.frombuffer(sentence_doc, np.int32)
    bag = np.repeat(np.arange(len(doc), dtype=np.int32), np.frombuffer(lengths, np.int32))
    # features by hash: word -> features, of those that enough documents have
    codes, per_word = array("Q"), array("i")
    for w in number:
        found = features(w)
        per_word.append(len(found))
        codes.extend(map(xxhash.xxh3_64_intdigest, found))
    hashes, pf = np.unique(np.frombuffer(codes, np.uint64), return_inverse=True)
    times = np.frombuffer(per_word, np.int32)
    pw = np.repeat(np.arange(len(number)), times)
    begin = np.cumsum(times) - times
    df = np.zeros(len(hashes), np.int64)
    cuts = np.searchsorted(doc[bag], np.arange(0, len(texts) + 256, 256))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        seen = np.unique(doc[bag[lo:hi]].astype(np.int64) * len(number) + word[lo:hi])
        d, w = np.divmod(seen, len(number))
        at = np.repeat(begin[w] - np.cumsum(times[w]) + times[w], times[w]) + np.arange(times[w].sum())
        df += np.bincount(np.unique(np.repeat(d, times[w]) * len(hashes) + pf[at]) % len(hashes), minlength=len(hashes))
    use = df[pf] >= least
    pw, used = pw[use], pf[use]
    hashes, pf = hashes[np.unique(used)], np.unique(used, return_inverse=True)[1]
    del codes, df, use, used, begin
    fit = _Fit(y, len(hashes), len(number), l1)
    plain = np.zeros(len(y))
    fit.run(epochs, rate, word, bag, doc, plain, pw, pf)
    # the features that are left touch few sentences; all others only count
    live = fit.w[pf] != 0
    pw, pf = pw[live], pf[live]
    words, pw = np.unique(pw, return_inverse=True)
    left, pf = np.unique(pf, return_inverse=True)
    touched = np.isin(word, words)
    kept = np.unique(bag[touched])
    plain = np.bincount(np.delete(doc, kept), minlength=len(y)).astype(float)
    fit.narrow(left, len(words))
    fit.run(12 * epochs, rate, np.searchsorted(words, word[touched]), np.searchsorted(kept, bag[touched]), doc[kept], plain, pw, pf)
    weight = {int(h): float(x) for h, x in zip(hashes[left], fit.w, strict=True) if x}
    return Model(float(fit.b), {f: weight[h] for w in number for f in features(w) if (h := xxhash.xxh3_64_intdigest(f)) in weight})


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, longest: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of labelled documents outside fold 1.

    At most `most` documents, half of either label, in an order that depends
    on a hash of the id alone, each of at most `longest` bytes: the sample
    that reaches the driver has a size known beforehand, however large the
    input (here under 270 MB, 13 MB as a rule). Several labels of one id: the
    largest counts. Null labels are ignored."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (0, 1):
        # a margin for labels whose document is missing or too long
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most * 3 // 4)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents(docs, id_col, text_col).where(F.length("text") <= longest)
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select(F.col("text").cast("string"), "toxic").toArrow()
    texts, toxic = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    del rows
    return train(texts, toxic)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, sentences) of every document, whole texts:
    noisy-or score between 0 and 1, 1 where it reaches the threshold, and for
    those the offending sentences. Null and empty texts score 0."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        s = model.scorer()
        for b in _slices(batches):
            texts = b.column(1).cast(pa.string()).to_pylist()
            scores = [s.score(t) for t in texts]
            spans = [[dict(zip(("start", "end", "probability"), x, strict=True)) for x in s.sentences(t)] if p >= threshold else [] for t, p in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(p >= threshold) for p in scores], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "sentences"])

    schema = "doc_id long, score double, predicted int, sentences array<struct<start:long,end:long,probability:double>>"
    return documents(docs, id_col, text_col).mapInArrow(run, schema).withColumn("doc_id", id_out())


def _slices(batches, rows: int = 256):
    """A few rows at a time: what Python holds does not follow the batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold.
    Only texts go to Python and only verdicts come back."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        s = model.scorer()
        for b in batches:
            parts = [[s.score(t or "") < threshold for t in b.slice(at, 256).to_pylist()] for at in range(0, len(b), 256)]
            yield pa.array([x for p in parts for x in p], pa.bool_())
        del s
        give_back()

    bounded_batches(docs.sparkSession)
    return docs.where(clean(F.col(f"`{text_col}`")))
