"""Quality rules: a threshold table compiled into one projection (no shuffle, no user functions).

Words are runs of ``[^\\x20\\x09-\\x0D]``. A null text counts as having no words. Empty and blank texts,
like all texts under ten words, fail the base rule and are not kept. Repeated rows are judged alike,
each on its own. Other columns of the input are ignored by ``quality_metrics`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()"
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by at or from this an he not which "
    "le la les de des du et un une en que qui dans pour par sur est pas avec au aux "
    "der die das und von zu den dem mit sich ist im nicht ein eine auf für es auch "
    "el los las del y una con no se lo su al como más por para"
).split()
WINDOW = 5
#: Counts that rules may name, and the part of the text that each is taken from.
METRICS = dict.fromkeys(("n_words", "word_chars", "n_stop_words", "n_repeat_words"), "words") | dict.fromkeys(("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines"), "lines") | {"n_symbols": "rest"}


@dataclass(frozen=True)
class Rule:
    """Fails where ``100 * part`` is below ``least`` or above ``most`` times ``whole``; both are names of metrics."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: Percentages. mean_word: 100 * characters / words.
RULES = (
    Rule("mean_word", "word_chars", "n_words", 200, 1600),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=30),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
)


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows of five words found at least twice in the text.

    Windows are compared by 64-bit hashes. Most texts repeat none, which one pass over the hashes shows;
    only the others sort them.
    """

    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    def covered(q: Column) -> Column:
        return F.aggregate(
            F.transform(q, lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get(q, j + 1) - p), F.lit(WINDOW))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ranked, lambda s: let(places(s), covered)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: window(words, i))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


def metrics(text: Column) -> Column:
    """A struct of all counts that rules may name, of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    def of_words(w: Column) -> Column:
        stop = F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(PUNCTUATION))).isin(STOP_WORDS))
        return F.struct(_count(w).alias("n_words"), _count(stop).alias("n_stop_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            _count(x).alias("n_lines"),
            (_count(x) - _count(F.array_distinct(x))).alias("n_dup_lines"),
            _count(F.filter(x, lambda y: F.rtrim(y, F.lit(" \t\r")).endswith("...") | F.rtrim(y, F.lit(" \t\r")).endswith("…"))).alias("n_ellipsis_lines"),
            _count(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"),
        )

    symbols = F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))
    rest = F.struct(symbols.cast("long").alias("n_symbols"))
    parts = F.struct(let(words, of_words).alias("words"), let(lines, of_lines).alias("lines"), rest.alias("rest"))
    return let(parts, lambda p: F.struct(*(p[METRICS[c]][c].alias(c) for c in METRICS)))


def compile_rules(m: Column, rules=RULES) -> Column:
    """Names of the rules that fail for the metrics ``m``, in the table's order."""
    checks = []
    for r in rules:
        part, whole = m[r.part] * 100, m[r.whole]
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (part < whole * r.least)
        if r.most is not None:
            bad = bad | (part > whole * r.most)
        checks.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*checks))


def judge(text: Column, rules=RULES) -> Column:
    """One expression with all counts and the verdict; each count is evaluated once per row."""

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)
        failed = compile_rules(m, rules)
        return F.struct(*(m[c].alias(c) for c in METRICS), base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))

    return let(let(F.coalesce(text, F.lit("")), metrics), verdict)


def quality_metrics(documents: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, ``kept`` and ``failed_rules`` to each row.

    Columns of the input with one of these names are replaced.
    """
    own = [*METRICS, "base_failed", "kept", "failed_rules"]
    name = free_name(documents, "judged")
    judged = documents.select(*(F.col(c) for c in documents.columns if c not in own), judge(F.col(text), rules).alias(name))
    return judged.select(*(F.col(c) for c in documents.columns if c not in own), *(F.col(name)[c].alias(c) for c in own))


def filter_documents(documents: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows that all rules keep, with the input's columns as they were."""
    return documents.where(judge(F.col(text), rules)["kept"])
