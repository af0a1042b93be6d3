"""Quality rules judged per host.

Every document is measured once (one narrow pass over the text). Rule
failures are counted by host, the failure rate of each rule is shrunk towards
the rate of all hosts with a beta prior fitted to them, and the verdict on
the host is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WHITE, checkpoint, id_out

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = WHITE + bytes(range(0x80, 0xC0))  # white space and the continuation bytes of UTF-8


def measure(text: bytes) -> tuple[int, ...]:
    """The METRICS of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    # pairs are numbered first, so that three ids always fit into 64 bits
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def document_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, *METRICS) of every document, whole texts. Null texts have no words."""
    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column(2).to_pylist()]
            cols = zip(*rows, strict=True) if rows else ((),) * len(METRICS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "host", *METRICS])

    d = df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )
    return d.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in METRICS))


#: Rules as SQL conditions on the metrics: true where a document fails.
RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def host_verdicts(metrics: DataFrame, rules: dict[str, str] | None = None, limit: float = 0.5) -> DataFrame:
    """(host, n_docs, <rule>_rate..., rejected): rates after shrinking.

    For each rule the prior is Beta(m * s, (1 - m) * s) with m the mean of the
    hosts' raw rates and s = m * (1 - m) / variance - 1 by moments. Where all
    hosts have one rate (variance 0 or a single host), s is taken as 0: no
    shrinking is needed. A host is rejected if any shrunk rate exceeds the
    limit. Counts are combined before the shuffle, so a host with a third of
    all documents costs one row per task. Documents without a host form none."""
    rules = rules or RULES
    counts = metrics.where("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n_docs"), *(F.sum(F.expr(f"CASE WHEN {r} THEN 1 ELSE 0 END")).alias(f"{k}_failed") for k, r in rules.items())
    )
    counts = checkpoint(counts)
    prior = counts.agg(*(x for k in rules for x in (
        F.avg(F.col(f"{k}_failed") / F.col("n_docs")).alias(f"{k}_m"), F.var_samp(F.col(f"{k}_failed") / F.col("n_docs")).alias(f"{k}_v"),
    ))).first()
    out = counts.select("host", "n_docs", *(_shrunk(k, prior[f"{k}_m"], prior[f"{k}_v"]).alias(f"{k}_rate") for k in rules))
    worst = F.greatest(*(F.col(f"{k}_rate") for k in rules)) if len(rules) > 1 else F.col(f"{next(iter(rules))}_rate")
    return out.withColumn("rejected", worst > limit)


def _shrunk(rule: str, m: float | None, v: float | None):
    m = m or 0.0
    s = max(0.0, m * (1 - m) / v - 1) if v and v == v else 0.0
    return (F.col(f"{rule}_failed") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s))


def judge(df: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, *METRICS, base_failed, host_rejected, kept) of every
    document. The measures are written once; only rejected hosts are joined
    back, by a join whose side Spark sends out only if its known size allows.
    A document without a host is judged by its own rule alone."""
    metrics = checkpoint(document_metrics(df, id_col, text_col, host_col))
    rejected = checkpoint(host_verdicts(metrics, limit=limit).where("rejected").select("host", F.lit(True).alias("host_rejected")))
    d = metrics.join(rejected, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    d = d.withColumn("base_failed", F.expr(RULES["base"]))
    return d.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).withColumn("doc_id", id_out())
