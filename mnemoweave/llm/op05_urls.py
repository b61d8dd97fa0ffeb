"""URL filters by association rules (operator 5, native).

Spark's FP-growth mines combinations of URL tokens that go with a label; rules
pruned by support, confidence (against the label's base rate) and redundancy are
matched by an inverted index (a rule stands under its rarest token).  Fixed
host/path rules come first.

Cases: a null url, or one without ``://``, has empty host and path, fits no
fixed rule and has no tokens; repeated urls are judged alike; urls are read whole,
however long; of rules with equal gain the one with more support decides, then the
last by its tokens; with no labelled urls nothing is mined and the default verdict
stands; an empty table gives no rows; extra columns are carried along, one named like an added column is
replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table

#: (host, path, verdict); the longest host + path wins.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MIN_SUPPORT, MIN_GAIN = 0.002, 0.1
#: A combination seen in fewer labelled urls than this is no evidence at any support.
MIN_COUNT = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """(host, path, query, fragment) columns; all empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, r"(?s)^[^#]*#(.*)", 1)
    return host, path, query, fragment


def fixed_rule(host, path, rules=RULES):
    """The longest fixed rule that fits: struct<size, rule, verdict>, or null.

    A map from rule host to its rules is probed with the host and its parent
    domains, so the cost of a row does not grow with the number of rules.
    """
    by_host: dict[str, list] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append(
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
        )
    table_ = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*rs))])
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    none = F.array().cast("array<struct<size:int,rule:string,path:string,verdict:string>>")
    fits = F.flatten(F.transform(domains, lambda d: F.coalesce(F.try_element_at(table_, d), none)))
    return F.array_max(F.filter(fits, lambda r: path.startswith(r["path"])))


def url_tokens(host, path, query, fragment):
    """Distinct tokens: words of the host, path parts without digits, how the
    path ends, parameters, fragment."""
    words = F.transform(F.split(host, r"[.-]", -1), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(
        F.filter(F.split(path, "/", -1), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("path="), x)
    )
    ends = F.array(F.concat(F.lit("end="), F.regexp_extract(path, r"(\.[A-Za-z]+|/)$", 1)))
    params = F.transform(F.split(query, "&", -1), lambda x: F.concat(F.lit("param="), x))
    frag = F.array(F.concat(F.lit("fragment="), fragment))
    every = F.concat(words, parts, ends, params, frag)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(every, lambda x: ~x.endswith("=")))
    )


def mine(
    labelled: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_gain: float = MIN_GAIN, min_count: int = MIN_COUNT,
) -> DataFrame:
    """Rules (antecedent, verdict, confidence, gain, support, key) from ``labelled(tokens, verdict)``.

    A rule's gain is by how much of the rest to certainty its confidence exceeds
    the verdict's share of all labels, so a rare verdict can have rules as well
    as a common one.  Pruned: below the bounds, and any rule that a rule on a
    subset of its tokens with the same verdict and at least its confidence makes
    redundant.  Their number is bounded by the support, not by the input.
    """
    items = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    # one number for each verdict
    share = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(share.values()))
    share = {v: n / total for v, n in share.items()}
    lowest = min((b + min_gain * (1 - b) for b in share.values()), default=1.0)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / total)), minConfidence=min(1.0, lowest) - 1e-9).fit(items)
    base = F.create_map(*[F.lit(x) for v, b in (share or {"": 1.0}).items() for x in (v, float(b))])
    rules = (
        model.associationRules.where(F.element_at("consequent", 1).startswith("verdict="))
        .where(~F.exists("antecedent", lambda x: x.startswith("verdict=")))
        .select(
            F.array_sort("antecedent").alias("antecedent"),
            F.regexp_replace(F.element_at("consequent", 1), "^verdict=", "").alias("verdict"),
            "confidence", "support",
        )
    )
    rules = rules.withColumn("b", F.try_element_at(base, F.col("verdict")))
    rules = rules.withColumn("gain", F.try_divide(F.col("confidence") - F.col("b"), 1 - F.col("b"))).where(F.col("gain") >= min_gain - 1e-12)
    rules = scratch.write(rules.drop("b"), "mined")
    short = rules.select(F.col("antecedent").alias("a"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    shadowed = (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (
        F.size("a") < F.size("antecedent")) & (F.size(F.array_except("a", "antecedent")) == 0)
    # a rule's subsets are among those that share its tokens: an equi-join on one token of the shorter
    short = short.withColumn("t", F.element_at("a", 1))
    long = rules.withColumn("t", F.explode("antecedent"))
    redundant = long.join(short, (long["t"] == short["t"]) & shadowed).select("antecedent", "verdict").distinct()
    rules = rules.join(redundant, ["antecedent", "verdict"], "left_anti")
    freq = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("t"), "freq")
    rarest = (
        rules.withColumn("t", F.explode("antecedent")).join(freq, "t")
        .groupBy("antecedent", "verdict", "confidence", "gain", "support")
        .agg(F.min_by("t", F.struct("freq", "t")).alias("key"))
    )
    return scratch.write(rarest, "rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The mined verdict of most gain for each distinct url: (url, mined, mined_rule)."""
    hits = (
        urls.withColumn("key", F.explode("tokens"))
        .join(rules.select("key", "antecedent", "verdict", "gain", "support"), "key")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.max(F.struct("gain", "support", "antecedent", "verdict"))
    return hits.groupBy("url").agg(best.alias("m")).select(
        "url", F.col("m.verdict").alias("mined"), F.array_join("m.antecedent", " & ").alias("mined_rule")
    )


def judge(pages: DataFrame, rules: DataFrame | None, fixed=RULES, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, mined_rule and verdict added."""
    base = pages.drop("host", "path", "rule", "mined_rule", "verdict")
    host, path, query, fragment = url_parts(F.col("url"))
    out = base.withColumns({"host": host, "path": path}).withColumn("_f", fixed_rule(F.col("host"), F.col("path"), fixed))
    if rules is None:
        out = out.withColumns({"mined": F.lit(None).cast("string"), "mined_rule": F.lit(None).cast("string")})
    else:
        distinct = base.select("url").where("url IS NOT NULL").distinct()
        urls = distinct.select("url", url_tokens(host, path, query, fragment).alias("tokens"))
        out = out.join(match(urls, rules), "url", "left")
    verdict = F.coalesce("_f.verdict", "mined", F.lit(default))
    return out.withColumns({"rule": F.col("_f.rule"), "verdict": verdict}).drop("_f", "mined")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens and verdicts of the urls whose number names a labelled document."""
    host, path, query, fragment = url_parts(F.col("url"))
    numbered = pages.select(
        url_tokens(host, path, query, fragment).alias("tokens"),
        F.regexp_extract(path, r"/(\d{1,18})(?:[/.]|$)", 1).try_cast("bigint").alias("doc_id"),
    ).where("doc_id IS NOT NULL")
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return numbered.join(marks, "doc_id").select(
        "tokens", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict")
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine(labelled_urls(pages, table(spark, sf_dir, "labels")), Scratch(spark, "op5"))
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
