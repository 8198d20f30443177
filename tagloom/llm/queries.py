"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, exact_dedup, licenses, line_dedup, lm, ngram_join, packing, pii, runs, tokens, toxicity, url_filter, whitening
from tagloom.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(path: str | None = None) -> str:
    """The text of a tokenizer file; by default the byte vocabulary of the installed public files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def pieces(docs: DataFrame) -> DataFrame:
    packed = packing.pack(docs, vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_packing(spark, folder):
    return pieces(_table(spark, folder, "documents"))


#: Notices of common licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


@query
def op1_license_scan(spark, folder):
    """Documents as files: a directory per source, two levels of numbers below, a licence file in ten."""
    n = F.col("doc_id")
    name = F.when(n % 10 == 0, F.concat(F.lit("LICENSE-"), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    # Licence files with even hundreds stand at the top of their source, other files two levels deeper.
    top = F.concat_ws("/", F.col("source"), F.when((n % 10 == 0) & (n % 200 < 100), F.lit(None)).otherwise((n % 7).cast("string")))
    path = F.concat_ws("/", top, F.when(n % 10 != 0, (n % 3).cast("string")), name)
    files = _table(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, [*NOTICES, *licenses.texts()])


RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


@query
def op3_url_filter(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labelled_by_rules(pages, RULES))
    return url_filter.judge(pages, RULES, model)


@query
def op4_hmm_lm(spark, folder):
    return lm.score(_table(spark, folder, "documents"), fold("doc_id") == 1)


@query
def op5_token_counts(spark, folder):
    counted = tokens.count_tokens(_table(spark, folder, "documents"), vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op6_line_dedup(spark, folder):
    kept = line_dedup.dedup_lines(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_exact_dedup(spark, folder):
    return exact_dedup.dedup(_table(spark, folder, "documents")).drop("origin")


@query
def op8_ngram_jaccard(spark, folder):
    return ngram_join.join(_table(spark, folder, "documents")).drop("origin")


@query
def op9_decontaminate(spark, folder):
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    judged = decontaminate.judge(decontaminate.scan(docs, benchmark, keep=["doc_id"]))
    named = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", named, "contaminated")


def machine(docs: DataFrame, labels: DataFrame) -> toxicity.Machine:
    """Trained on the labelled documents outside fold 0."""
    return toxicity.fit(docs, labels.filter(fold("doc_id") != 0))


@query
def op10_toxicity(spark, folder):
    docs = _table(spark, folder, "documents")
    scored = toxicity.score(docs, machine(docs, _table(spark, folder, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def repeating(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text; in a tenth of the documents, chosen by id, its words repeat with a period from some word on.

    A null id counts as the empty text, a null text as empty.
    """
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    begin = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - begin) / (3 + g % 8))
    unit = F.slice(words, (begin + 1).cast("int"), period.cast("int"))
    times = F.ceil((n - begin) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (n - begin).cast("int"))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), begin.cast("int")), tail), " ")
    return F.when(h % 10 == 0, whole).otherwise(F.col(text))


@query
def op11_periodic_runs(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", repeating().alias("text"))
    found = runs.find_runs(docs, keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("a"), (-r["start"]).alias("b"), (-r["period"]).alias("c"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.b")).alias("start"), F.col("best.a").alias("length"), (-F.col("best.c")).alias("period"),
        F.floor(1000 * F.col("best.a") / -F.col("best.c")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_embedding_whitening(spark, folder):
    """One row per vector and component. Entries beyond 2 ** 62 / 64 have no long ``x``: their rows go, as if not finite."""
    scaled = F.transform("embedding", lambda c: c.cast("double") * 64)
    x = F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 62), F.floor(c) + 1_000_000))  # else null, also for NaN
    rows = _table(spark, folder, "embeddings").select("vec_id", x.alias("x"))
    whitened, fit = whitening.whiten(rows, components=32)
    explained = fit.explained if fit else []
    return whitened.select(
        "vec_id", F.posexplode("whitened").alias("at", "whitened"), F.col("deviation").try_cast("long").alias("deviation")
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(fit.error if fit else 0.0).alias("identity_error"),
    )


@query
def op13_pii(spark, folder):
    """Counts and digest are of the patterns' spans; ``spans`` and ``n_added`` have those of the field too."""
    docs = _table(spark, folder, "documents")
    found = pii.find(docs, pii.fit(docs), keep=["doc_id"])

    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    added = (F.size("found") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("found")).alias("spans"), added)
