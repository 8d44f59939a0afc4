"""Scores per parser: means of available metrics, weighted dimensions, hard gates, confusion and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cost_score, runtime_score

#: Weights, metric groups and gates (fixed values).
WEIGHTS = {"structure_correctness": 0.30, "critical_field_correctness": 0.25, "text_fidelity": 0.20, "scan_robustness": 0.10, "runtime_cost": 0.10, "integration_simplicity": 0.05}
STRUCTURE = ("reading_order_accuracy", "heading_hierarchy_f1", "list_preservation", "table_structure_score", "header_footer_leakage", "provenance_completeness", "page_attribution_accuracy")
TEXT = ("character_accuracy", "word_accuracy", "diacritic_preservation")
MIN_READING_ORDER, MIN_PROVENANCE, MIN_EVIDENCE = 0.70, 1.0, 30
SCAN_ROUTES = ("scanned", "mixed", "garbled_text_layer")


def mean_available(metrics: DataFrame, *keys: str) -> DataFrame:
    """Mean over all available values of a group, not a mean of means."""
    return metrics.where("available").groupBy(*keys).agg(F.avg("value").alias("mean"))


def _mean(names: tuple[str, ...], more: Column | None = None) -> Column:
    test = F.col("available") & F.col("name").isin(*names)
    return F.avg(F.when(test if more is None else test & more, F.col("value")))


def dimensions(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Per parser, the six dimensions (null if unavailable) and what gates need.

    ``metrics``: parser, document_id, name, value, available, route_expected (``critical_field_accuracy`` among the names).
    ``runs``: parser, document_id, parsed, seconds_per_page, requires_gpu, benefits_from_gpu, installed, severe_fields.
    """
    m = metrics.groupBy("parser").agg(
        _mean(STRUCTURE).alias("structure_correctness"),
        _mean(("critical_field_accuracy",)).alias("critical_field_correctness"),
        _mean(TEXT).alias("text_fidelity"),
        _mean(STRUCTURE + TEXT, F.col("route_expected").isin(*SCAN_ROUTES)).alias("scan_robustness"),
        _mean(("reading_order_accuracy",)).alias("reading_order"),
        _mean(("provenance_completeness",)).alias("provenance"),
    )
    r = runs.groupBy("parser").agg(
        F.count("*").alias("documents_attempted"),
        F.sum(F.col("parsed").cast("long")).alias("documents_parsed"),
        F.avg(F.when(F.col("parsed"), F.col("seconds_per_page"))).alias("seconds_per_page"),
        F.bool_or("requires_gpu").alias("requires_gpu"),
        F.bool_or("benefits_from_gpu").alias("benefits_from_gpu"),
        F.bool_and("installed").alias("installed"),
        F.sum(F.size("severe_fields")).alias("severe"),
    )
    best = r.agg(F.min("seconds_per_page").alias("best"))  # one row
    rows = r.join(m, "parser", "left").join(F.broadcast(best), how="left")
    return rows.withColumns({"runtime_cost": runtime_score(F.col("seconds_per_page"), F.col("best")), "integration_simplicity": cost_score(F.col("requires_gpu"), F.col("benefits_from_gpu"), F.col("installed"))})


def weighted(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds ``coverage`` (weight of available dimensions) and ``weighted_score`` over them."""
    coverage, total = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        coverage = coverage + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
        total = total + F.coalesce(F.col(name) * w, F.lit(0.0))
    return rows.withColumns({"coverage": coverage, "weighted_score": F.when(coverage > 0, total / coverage)})


def gates(rows: DataFrame) -> DataFrame:
    """Adds ``gate_failures`` and ``disqualified``."""
    failures = F.array_compact(
        F.array(
            F.when(F.col("reading_order") < MIN_READING_ORDER, "reading_order_corruption"),
            F.when(F.col("provenance") < MIN_PROVENANCE, "provenance_loss"),
            F.when(F.col("severe") > 0, "critical_fact_error"),
            F.when((F.col("documents_attempted") > 0) & (F.col("documents_parsed") == 0), "parse_failure"),
        )
    )
    return rows.withColumns({"gate_failures": failures, "disqualified": F.size(failures) > 0})


def parser_scores(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per parser: dimensions, coverage, score, failure rate, gates."""
    rows = gates(weighted(dimensions(metrics, runs)))
    rate = F.when(F.col("documents_attempted") == 0, 0.0).otherwise((F.col("documents_attempted") - F.col("documents_parsed")) / F.col("documents_attempted"))
    return rows.withColumn("failure_rate", rate)


def first_routes(runs: DataFrame) -> DataFrame:
    """Per pair of routes: ``n`` documents whose first run has it, and of those with an id, ``documents`` and the ``labelled`` ones.

    Of several first runs of a document those with an actual route come before others, then the least pair counts.
    """
    first, known = F.min(F.struct("run_seq", F.col("route_actual").isNull().alias("lost"), "route_expected", "route_actual")), F.col("document_id").isNotNull()
    labelled = F.bool_or("labelled") if "labelled" in runs.columns else F.lit(None).cast("boolean")
    rows = runs.groupBy("document_id").agg(first.alias("first"), labelled.alias("labelled"))
    return rows.groupBy("first.route_expected", "first.route_actual").agg(F.count("*").alias("n"), F.count_if(known).alias("documents"), F.count_if(known & F.col("labelled")).alias("labelled"))


def confusion(firsts: DataFrame) -> DataFrame:
    """The counts of ``first_routes`` where there is an actual route; null routes do not vote."""
    return firsts.where("route_actual is not null").select("route_expected", "route_actual", "n")


def route_confusion(runs: DataFrame) -> DataFrame:
    """Counts of expected and actual routes; a document votes once, with its first run; null routes do not vote."""
    return confusion(first_routes(runs))


def _judged(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sufficient", F.col("labelled") >= MIN_EVIDENCE)


def evidence_of(firsts: DataFrame) -> DataFrame:
    """The row of ``evidence`` from the counts of ``first_routes``."""
    return _judged(firsts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "labelled"))))


def evidence(runs: DataFrame) -> DataFrame:
    """One row: documents, labelled documents, and whether they suffice."""
    labelled = F.count_distinct(F.when(F.col("labelled"), F.col("document_id")))
    return _judged(runs.agg(F.count_distinct("document_id").alias("documents"), labelled.alias("labelled")))


def manifest_routes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("route_label").agg(F.count("*").alias("n")).orderBy("route_label")


def run_pairs(parsers: DataFrame, documents: DataFrame) -> DataFrame:
    """Every parser with every document; ``parsers`` is a handful of rows and is broadcast."""
    return documents.join(F.broadcast(parsers), how="cross")


REPORT_COLUMNS = ("parser", "document_id", "status", "route_expected", "route_actual", "page_count", "duration_ms", "seconds_per_page", "peak_rss_mb", "error_code", "critical_field_accuracy", "severity_3_fields", *STRUCTURE, *TEXT)


def per_document_report(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The fixed columns of the report as text: two decimals for times, four for values, empty where unavailable.

    Of several values of one metric for a parser and document the greatest counts, so that repeated runs give the same report
    however rows are dealt out. Runs and values are dealt out once, by ranges of parser and document, in which they meet and
    are sorted without a join.
    """
    names = [*STRUCTURE, *TEXT, "critical_field_accuracy"]
    number = lambda c, n: F.coalesce(F.format_string(f"%.{n}f", F.col(c).cast("double")), F.lit(""))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    keys, told = ["parser", "document_id"], ["status", "route_expected", "route_actual", "page_count", "duration_ms", "seconds_per_page", "peak_rss_mb", "error_code", "severe_fields"]
    known = F.col("parser").isNotNull() & F.col("document_id").isNotNull()  # without them a run has no values
    # Texts are made after the rows are dealt out: numbers are shorter.
    own = runs.select(*(text(F.col(c)).alias(c) for c in keys), F.struct(*(F.array_join(c, ";").alias(c) if c == "severe_fields" else c for c in told), known.alias("_known")).alias("_run"))
    values = metrics.where(known & F.col("available") & F.col("value").isNotNull() & F.col("name").isin(names))
    values = values.select(*(F.col(c).cast("string").alias(c) for c in keys), F.array_position(F.array(*map(F.lit, names)), F.col("name")).cast("tinyint").alias("_at"), F.col("value").cast("double").alias("_value"))
    rows = own.unionByName(values, allowMissingColumns=True).repartitionByRange(*keys)
    each = Window.partitionBy(*keys)
    rows = rows.withColumns({c: F.max(F.when(F.col("_at") == i, F.col("_value"))).over(each) for i, c in enumerate(names, 1)}).where("_run is not null")
    rows = rows.select(*keys, "_run.*", *names)
    made = {"severity_3_fields": F.col("severe_fields")} | {c: F.when(F.col("_known") & F.col(c).isNotNull(), number(c, 4)).otherwise("") for c in names}
    for c, n in (("duration_ms", 2), ("seconds_per_page", 4), ("peak_rss_mb", 2)):
        made[c] = F.when(F.col(c).isNotNull(), number(c, n)).otherwise("")
    return rows.select(*keys, *((made[c] if c in made else text(F.col(c))).alias(c) for c in REPORT_COLUMNS if c not in keys))
