"""URL filter: allow and block rules, and for the rest a logistic regression
on hashed character n-grams of host and path, trained from a small labelled
table of URLs.

Everything runs as DataFrame and SQL functions. Judging is one narrow pass
over the url column: rules are a chain of conditions, the model is applied to
a sparse vector of hashed n-gram counts.
"""

from __future__ import annotations

import string
from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
SIZES = (3, 4, 5)
SEPARATOR = "://"

#: The labelled table: words for hosts of either kind, combined with the
#: address patterns below (some 2,500 rows).
BLOCKED_WORDS = ["casino", "bets", "pills", "adult", "spam", "ads", "track", "porn", "xxx", "poker", "slots", "viagra", "cheap", "free-win", "loans", "replica", "lottery", "click-farm"]
ALLOWED_WORDS = ["news", "library", "garden", "school", "museum", "weather", "recipes", "history", "science", "travel", "music", "health", "archive", "forum", "city", "theater", "blog", "shop-local", "cooking", "football"]
#: Ordinary names are also made of two of the commonest letter groups of English each.
GROUPS = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ing", "tion", "st"]
PATTERNS = ["http://{w}.example.org/en/{n}", "https://www.{w}.example.com/de/{n}?page=2", "https://blog.{w}.example.net/fr/{n}/", "http://m.{w}.example.org/es/{n}#top", "https://{w}-{x}.example.org/en/{n}/", "http://blog.{x}-{w}.example.com/{n}", "https://m.{w}{x}.example.net/en/{n}"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for hosts to block. Every pattern occurs with every
    word, so scheme, prefix, language, number and domain tell nothing."""
    rows = []
    made = [a + b for a, b in product(GROUPS, GROUPS) if a != b]
    for words, label in ((BLOCKED_WORDS, 1.0), (ALLOWED_WORDS + made[::2], 0.0)):
        for (i, w), (j, p) in product(enumerate(words), enumerate(PATTERNS)):
            rows += [(p.format(w=w, x=words[(i + k) % len(words)], n=1000 + 37 * i + 1001 * j + k), label) for k in (1, 5)]
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z
    lower-cased. Path: from there up to "?", "#" or the end. Both are empty
    for a null url or one without "://"."""
    at = F.instr(url, SEPARATOR)
    rest = F.when(at > 0, F.substring(url, at + len(SEPARATOR), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) by the longest rule that fits, null if none does. A
    rule is a host followed by the start of a path; it covers subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of "^host$" and of "^path$" (numbers as 0), marked by part."""
    out = []
    for mark, text in (("h", host), ("p", F.regexp_replace(path, r"[0-9]+", "0"))):
        out += [_grams(mark, F.concat(F.lit("^"), text, F.lit("$")), n) for n in SIZES]
    return F.concat(*out)


def _grams(mark: str, text: Column, n: int) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, n)))


def with_features(df: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Counts of the hashed n-grams of the columns host and path, as a sparse vector `features`."""
    hashing = HashingTF(numFeatures=dimensions, inputCol="_grams", outputCol="features")
    return hashing.transform(df.withColumn("_grams", ngrams(F.col("host"), F.col("path")))).drop("_grams")


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, strength: float = 0.002):
    """A fitted model, or the one label (or null) if there are fewer than two.
    The table is small by its nature; its size does not follow the pages."""
    host, path = host_and_path(F.col("url"))
    rows = with_features(labelled.where("label IS NOT NULL").select("label", host.alias("host"), path.alias("path")), dimensions)
    labels = [r[0] for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else None
    return LogisticRegression(regParam=strength, standardization=False, maxIter=50).fit(rows.select("label", "features"))


def with_score(df: DataFrame, model, dimensions: int = DIMENSIONS) -> DataFrame:
    """`score`: probability of label 1 from host and path; without a model the one known label, else 0."""
    if not isinstance(model, LogisticRegressionModel):
        return df.withColumn("score", F.lit(float(model or 0.0)))
    scored = model.transform(with_features(df, dimensions))
    return scored.withColumn("score", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page. `rules` are
    (allow | block, host/path-start). Null urls, empty hosts and repeated rows
    are judged like any other; other columns are ignored."""
    model = train(labelled)
    host, path = host_and_path(F.col("url"))
    d = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_column(F.col("host"), F.col("path"), rules)
    d = with_score(d, model).select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), "score")
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return d.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
