"""URL filter: rules by host and path, and boosted trees for urls that no rule decides.

The urls that a rule decides are the labelled ones. Trees learn from lexical features of
the url (lengths, depth, digit ratio, entropy, parameters, and the share of blocked urls
among labelled ones with the same suffix) and judge the rest. All of it is SQL
expressions and Spark ML on the JVM; only the url column is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mound.llm.tables import ascii_lower, row_hash, settle

# The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FIT_URLS = 20_000
# Parts of the hosts that suffix statistics leave out in turn.
FOLDS = 5
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio",
    "entropy", "parameters", "query_length", "fragment", "suffix_rate", "suffix_seen",
)


def host_and_path(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return {"host": ascii_lower(F.regexp_extract(found, parts, 1)), "path": F.regexp_extract(found, parts, 2)}


def rule_of(rules: tuple[tuple[str, str], ...]) -> dict[str, Column]:
    """The longest rule that fits ``host`` (itself or a subdomain) and ``path`` (its start), and its verdict."""

    def fits(rule: str) -> Column:
        host, slash, path = rule.partition("/")
        same = (F.col("host") == host) | F.col("host").endswith("." + host)
        return same & F.col("path").startswith(slash + path)

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    none = F.lit(None).cast("string")
    pick = lambda i: reduce(lambda rest, r: F.when(fits(r[0]), F.lit(r[i])).otherwise(rest), reversed(ordered), none)
    return {"rule": pick(0), "rule_verdict": pick(1)}


def lexical(url: str = "url") -> dict[str, Column]:
    """Features of the url's characters alone."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    chars = F.when(n > 0, F.array_sort(F.split(u, ""))).otherwise(F.array().cast("array<string>"))
    # Sorted characters: the places where a run ends give the counts.
    count = lambda class_: F.regexp_count(u, F.lit(class_)).cast("double")
    ends = F.filter(F.sequence(F.lit(0), F.size("_chars")), lambda i: (i == 0) | (i == F.size("_chars")) | (F.get("_chars", i) != F.get("_chars", i - 1)))
    runs = F.transform(F.sequence(F.lit(1), F.size("_ends") - 1), lambda i: F.get("_ends", i) - F.get("_ends", i - 1))
    bits = F.aggregate("_runs", F.lit(0.0), lambda s, k: s - k / F.size("_chars") * F.log2(k / F.size("_chars")))
    query = F.when(u.contains("?"), F.substring_index(F.substring_index(u, "#", 1), "?", -1)).otherwise(F.lit(""))
    return {
        "_chars": chars, "_ends": ends, "_runs": F.when(F.size("_chars") > 0, runs).otherwise(F.array().cast("array<int>")),
        "url_length": n.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": count("-"), "digit_ratio": F.when(n > 0, count("[0-9]") / n).otherwise(0.0),
        "entropy": bits,
        "parameters": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "query_length": F.length(query).cast("double"), "fragment": u.contains("#").cast("double"),
        "suffix": F.when(F.col("host") != "", F.substring_index("host", ".", -1)).otherwise(F.lit("")),
    }


def featured(rows: DataFrame) -> DataFrame:
    """Rows with ``url``, ``host``, ``path`` and their lexical features."""
    for name, value in lexical().items():
        rows = rows.withColumn(name, value)
    return rows.drop("_chars", "_ends", "_runs")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Share of blocked among labelled urls of each suffix, drawn to one half where few are seen.

    A row of ``fold`` null holds for urls to be judged. Rows of a fold leave out the labelled urls of hosts of
    that fold: what the trees learn from a url does not hold its own label, nor that of its host.
    """
    sums = labelled.groupBy("suffix", fold().alias("fold")).agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    own = settle(sums)
    whole = own.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    folds = own.join(whole, "suffix").select("suffix", "fold", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_k") - F.col("k")).alias("k"))
    every = whole.select("suffix", F.lit(None).cast("int").alias("fold"), F.col("all_n").alias("n"), F.col("all_k").alias("k"))
    n, k = F.col("n"), F.col("k")
    return every.unionByName(folds).select("suffix", "fold", ((k + 1) / (n + 2)).alias("suffix_rate"), F.log1p(n.cast("double")).alias("suffix_seen"))


def fold() -> Column:
    """One of ``FOLDS`` parts of the hosts."""
    return F.pmod(F.xxhash64(F.lit(23), "host"), F.lit(FOLDS)).cast("int")


def with_suffix(rows: DataFrame, statistics: DataFrame, learning: bool = False) -> DataFrame:
    """Join the statistics, those of the row's fold if it is for ``learning``; an unseen suffix has rate one half and count 0."""
    if learning:
        own = statistics.filter("fold is not null")
        out = rows.withColumn("fold", fold()).join(own, ["suffix", "fold"], "left").drop("fold")
    else:
        out = rows.join(statistics.filter("fold is null").drop("fold"), "suffix", "left")
    return out.na.fill({"suffix_rate": 0.5, "suffix_seen": 0.0})


def fit(labelled: DataFrame, fit_urls: int = FIT_URLS) -> GBTClassificationModel | None:
    """Boosted trees on at most about ``fit_urls`` labelled rows, chosen by hash; None without both labels.

    Equal urls count once, so a hot one does not pass the bound.
    """
    labelled = labelled.select("url", "host", "label", *FEATURES).dropDuplicates(["url", "host"])
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.pmod(row_hash(5, "url", "host"), F.lit(sum(counts.values()))) < fit_urls
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled.filter(share))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=8, maxDepth=3, seed=3, maxBins=32)
    return trees.fit(settle(rows.select("features", "label")))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, fit_urls: int = FIT_URLS) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` to every page.

    A rule's verdict stands; elsewhere the trees' does. Where no rule decides any page, or all that do agree,
    there is nothing to learn from and the verdict is the one that was seen, else allow. A null url has an empty host
    and path, no rule, and the verdict its features give. Columns of these names are replaced; equal urls are judged alike.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    rows = pages.select(F.struct("*").alias("page"), "url").withColumns(host_and_path(F.col("url"))).withColumns(rule_of(rules))
    rows = featured(rows)
    labelled = rows.filter("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    statistics = settle(suffix_statistics(labelled))
    rows = with_suffix(rows, statistics)
    model = fit(with_suffix(labelled, statistics, True), fit_urls)
    if model is None:
        seen = labelled.select(F.max("label")).first()[0] or 0.0
        rows = rows.withColumn("block_score", F.lit(float(seen)))
    else:
        rows = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        rows = rows.withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return rows.select(*[F.col(f"page.`{c}`") for c in kept], "host", "path", "rule", verdict.alias("verdict"), "block_score")
