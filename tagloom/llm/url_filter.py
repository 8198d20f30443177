"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

The regression learns from a bounded table of URLs with known verdicts. All work is done by column
expressions and Spark's own feature and classifier stages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ASCII_UPPER, stored


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains), the begin of the path, and the verdict: allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z) and the path; both empty without ``://``."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null if none fits. Ties: the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):  # the last one asked is the longest
        fits = (host == rule.host) | host.endswith("." + rule.host)
        named = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits & path.startswith(rule.path), named).otherwise(found)
    return found


def ngrams(host: Column, path: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """Character n-grams of ``^host$`` and of the path, marked by where they stand."""

    def of(text: Column, mark: str, n: int) -> Column:
        letters = F.split(text, "")
        last = F.size(letters) - n
        grams = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(letters, i, n), "")))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    bounded = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*[of(bounded, "h", n) for n in sizes], *[of(path, "p", n) for n in sizes])


def _features(urls: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    parts = urls.withColumns({"host": host, "path": path})
    return parts.withColumn("grams", ngrams(F.col("host"), F.col("path")))


def fit(
    labelled: DataFrame, url: str = "url", blocked: str = "blocked", max_rows: int = 20_000, buckets: int = 1 << 14,
    penalty: float = 1e-3, rounds: int = 60,
) -> PipelineModel | str:
    """Train on at most ``max_rows`` URLs with a known boolean ``blocked`` (null: left out).

    Of more rows, those with the smallest hashes are taken. If no row or only one verdict is known,
    the answer is that verdict (allow without rows) instead of a model.
    """
    known = labelled.filter(F.col(blocked).isNotNull()).select(F.col(url).alias("url"), F.col(blocked).cast("double").alias("label"))
    # One row per URL and verdict; a rule of hash and limit keeps the table bounded and the same on every run.
    bounded = known.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    table = stored(bounded, "labelled-urls")
    seen = {r["label"] for r in table.select("label").distinct().collect()}
    if len(seen) < 2:
        return "block" if seen == {1.0} else "allow"
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True)
    regression = LogisticRegression(maxIter=rounds, regParam=penalty, featuresCol="features", labelCol="label")
    return Pipeline(stages=[hashing, regression]).fit(_features(table, "url").select("label", "grams"))


def judge(pages: DataFrame, rules: Sequence[Rule], model: PipelineModel | str, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Per row the columns ``keep`` and ``host, path, rule, verdict``.

    The longest rule decides; without one the model does. A null or malformed URL has an empty host
    and path and goes to the model.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(url).alias("url"))
    rows = _features(rows, "url")
    if isinstance(model, str):
        guessed = rows.withColumn("guess", F.lit(model))
    else:
        guessed = model.transform(rows).withColumn("guess", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    found = matched_rule(F.col("host"), F.col("path"), rules)
    guessed = guessed.withColumn("found", found)
    verdict = F.coalesce(F.col("found.verdict"), F.col("guess"))
    kept = [F.col(n).alias(c) for c, n in zip(keep, names)]
    return guessed.select(*kept, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """URLs that a rule decides, with ``blocked``: labels for the model."""
    host, path = host_and_path(F.col(url))
    found = pages.select(F.col(url).alias("url")).withColumn("found", matched_rule(host, path, rules))
    return found.filter("found is not null").select("url", (F.col("found.verdict") == "block").alias("blocked"))
