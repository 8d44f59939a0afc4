"""URL filter: prefix rules first, then boosted trees on lexical features; column expressions throughout.

Without given labels, pages label their urls by content: thin pages and pages made of links count as blocked. The trees
see only the url. Where there is no html either, hosts with one of a few seed terms count as blocked.

A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees on
its (empty) features. Empty tables give empty results. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import bounded_sample, let

#: (rule, verdict): a rule is host and path prefix. At most ``MAX_RULES`` rules compile into one expression.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MAX_RULES = 1000
#: Words whose presence in a host marks a url as labelled "block" when no labelled urls are given.
SEED_TERMS = ("casino", "pills", "bets", "adult", "spam", "ads-", "porn", "viagra", "loan", "track")
#: At most this many labelled urls are used to fit the trees.
MAX_TRAIN = 10_000
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "longest_label", "vowel_ratio", "suffix_rate")
THRESHOLD = 0.5
#: Words of a page, and words for each of its links, below which it counts as blocked.
THIN, LINKED = 120, 15


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equals, block wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""

    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(F.split(text, ""), of))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``suffix`` and the lexical features; columns with these names are replaced."""
    host, path = split_url(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    count = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    labels = F.split(host, r"\.")
    size = lambda t: F.greatest(F.length(t), F.lit(1))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "length": F.length(text).cast("double"),
            "host_length": F.length(host).cast("double"),
            "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": count(text, "0123456789") / size(text),
            "entropy": _entropy(host),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "hyphens": count(host, "-").cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "vowel_ratio": count(host, "aeiou") / size(host),
        }
    )


def seed_labels(urls: DataFrame, url: str = "url", terms=SEED_TERMS) -> DataFrame:
    """``url, label``: 1 where the host holds a seed term, else 0. Urls without a host are left out."""
    host, _ = split_url(F.col(url))
    rows = urls.select(F.col(url).alias("url"), host.alias("_host")).where("_host <> ''")
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.col("_host"), F.lit(t))
    return rows.select("url", hit.cast("double").alias("label"))


def page_labels(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url, label``: 1 for pages of fewer than ``THIN`` words outside of tags or of more than a link for each ``LINKED`` words.

    Pages without url or html are left out.
    """
    visible = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    rows = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(F.col(url).alias("url"), F.regexp_count(visible, F.lit(r"\S+")).alias("words"), F.regexp_count(F.col(html), F.lit(r"(?i)<a\b")).alias("links"))
    return rows.select("url", ((F.col("words") < THIN) | (F.col("links") * LINKED > F.col("words"))).cast("double").alias("label"))


def train(labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list, dict[str, float]]:
    """Trees and the smoothed share of blocked urls by suffix, from at most ``max_train`` labelled rows.

    Half of the sample's urls (by hash) give the suffix statistics and the other half the trees, which thus see them as
    they are at use.
    """
    sample = lexical(bounded_sample(labelled, max_train)).withColumn("_half", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2))).persist()
    try:
        stats = sample.where("_half = 0").groupBy("suffix").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).collect()  # at most max_train
        base = (sum(r["bad"] for r in stats) + 1) / (sum(r["n"] for r in stats) + 2)
        suffixes = {r["suffix"]: (r["bad"] + 10 * base) / (r["n"] + 10) for r in stats} | {"": base}
        rows = sample.where("_half = 1").withColumn("suffix_rate", _suffix_rate(suffixes))
        return boosting.fit(rows, list(FEATURES), "label"), suffixes
    finally:
        sample.unpersist()


def _suffix_rate(suffixes: dict[str, float]) -> Column:
    """The share for suffixes of the sample; the overall share for the rest."""
    pairs = [F.lit(x) for k, v in suffixes.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(F.col("suffix"), F.lit(""))], F.lit(suffixes[""]))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = THRESHOLD, url: str = "url") -> DataFrame:
    """Adds ``host, path, rule, block_score, verdict`` and the features to each row."""
    if labelled is None:
        labelled = page_labels(bounded_sample(pages.select(url, "html"), MAX_TRAIN), url) if "html" in pages.columns else seed_labels(pages, url)
    trees, suffixes = train(labelled)
    rows = lexical(pages, url).withColumn("suffix_rate", _suffix_rate(suffixes))
    rows = rows.withColumn("block_score", boosting.probability(trees, [F.col(c) for c in FEATURES]))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own))
