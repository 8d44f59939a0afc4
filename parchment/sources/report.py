"""The report of a benchmark run: several artefacts, written together and read back.

``levels`` sums metrics on all levels in one pass (grouping sets). ``bundle`` makes the artefacts as tables, ``write`` puts
them under ``<root>/<run id>/<artefact>`` and a list of them last, so a run without its list is not there. Objects have
sorted keys at every depth. Lines of the summary are rows with a section and a place; nothing passes through the driver.

Repeated runs of one parser and document are listed as they are. Empty tables give a report that says so. Null messages are
empty, null scores ``n/a``. Columns other than the named ones are written to ``runs`` and ignored elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import score
from ..operators.staging import staged

ARTEFACTS = {"runs": "json", "levels": "json", "scores": "json", "confusion": "json", "failures": "json", "per_document": "csv", "summary": "text"}
CONTENTS = "contents"
#: Rows of a file; a compressed file is read by one task.
FILE_ROWS = 500_000


def sorted_keys(column: Column, kind: T.DataType) -> Column:
    """The same value with keys in order: of structs by name, of maps by key."""
    if isinstance(kind, T.StructType):
        fields = [sorted_keys(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.transform(column, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    return column


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, keys sorted, nulls kept: column ``value``."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    whole = F.struct(*(sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields))
    return rows.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def levels(metrics: DataFrame) -> DataFrame:
    """``level, parser, route_expected, name, mean, n, n_available``: over all, by parser, by metric, by both, by parser and route."""
    keys = ["parser", "route_expected", "name"]
    sets = {"all": [], "parser": ["parser"], "metric": ["name"], "parser_metric": ["parser", "name"], "parser_route": ["parser", "route_expected"]}
    rows = metrics.groupingSets([[F.col(k) for k in s] for s in sets.values()], *(F.col(k) for k in keys)).agg(
        F.grouping_id().alias("_g"), F.avg(F.when(F.col("available"), F.col("value"))).alias("mean"), F.count("*").alias("n"), F.count_if(F.col("available")).alias("n_available"),
    )
    number = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for name, s in sets.items()}
    level = reduce(lambda c, item: c.when(F.col("_g") == item[1], item[0]), number.items(), F.when(F.lit(False), ""))
    return rows.select(level.alias("level"), *keys, "mean", "n", "n_available")


def _lines(rows: DataFrame, section: int, line: Column, *order: Column) -> DataFrame:
    """Rows of a section of the summary; ``order`` as text, ascending."""
    return rows.select(F.lit(section).alias("section"), F.lit(1).alias("part"), F.array(*(o.cast("string") for o in order)).alias("place"), line.alias("line"))


def _head(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, 0, [f"{i:02d}"], x) for i, x in enumerate(lines)], "section int, part int, place array<string>, line string")


def summary(meta: dict[str, str], scores: DataFrame, confusion: DataFrame, failures: DataFrame, evidence: DataFrame) -> DataFrame:
    """``section, part, place, line``: the report as Markdown, in order of the first three."""
    spark = scores.sparkSession
    number = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("n/a"))
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[|\n]", " ")
    names = list(score.WEIGHTS)
    ranked = F.format_string("%020.12f", 1 - F.coalesce("weighted_score", F.lit(-1.0)))
    by_score = F.format_string("| %s | %s | %.2f | %d/%d | %.2f | %s |", "parser", number("weighted_score"), "coverage", "documents_parsed", "documents_attempted", "failure_rate", F.coalesce(F.nullif(F.array_join("gate_failures", ", "), F.lit("")), F.lit("-")))
    partial = scores.where("coverage < 0.9999")
    parts = [
        _head(spark, 0, f"# Run {meta.get('run_id', '')}", *(f"- {k}: {v}" for k, v in sorted(meta.items()))),
        _head(spark, 1, "## Scores", "| Parser | Score | Coverage | Parsed | Failure rate | Gates |", "|-|-|-|-|-|-|"),
        _lines(scores, 1, by_score, ranked, F.col("parser")),
        _head(spark, 2, "## Dimensions", "| Parser | " + " | ".join(names) + " |", "|-" * (len(names) + 1) + "|"),
        _lines(scores, 2, F.concat(F.lit("| "), "parser", F.lit(" | "), F.array_join(F.array(*map(number, names)), " | "), F.lit(" |")), F.col("parser")),
        _head(spark, 3, "## Routes", "| Expected | Produced | Documents |", "|-|-|-|"),
        _lines(confusion, 3, F.format_string("| %s | %s | %d |", cell(F.col("route_expected")), cell(F.col("route_actual")), "n"), F.col("route_expected"), F.col("route_actual")),
        _head(spark, 4, "## Failures", "| Parser | Document | Code | Message |", "|-|-|-|-|"),
        _lines(failures, 4, F.concat(F.lit("| "), F.array_join(F.array("parser", "document_id", cell(F.col("error.code")), cell(F.col("error.message"))), " | "), F.lit(" |")), F.col("parser"), F.col("document_id")),
        _head(spark, 5, "## Evidence"),
        _lines(evidence, 5, F.format_string("- Documents: %d, with labels: %d", "documents", "labelled"), F.lit("0")),
        _lines(evidence.where("not sufficient"), 5, F.lit(f"- Not enough for a decision: at least {score.MIN_EVIDENCE} labelled documents are needed."), F.lit("1")),
        _lines(partial, 5, F.format_string("- %s: scored over %.2f of 1.00 weight; missing dimensions are left out, not counted as zero.", "parser", "coverage"), F.lit("2"), F.col("parser")),
    ]
    return reduce(DataFrame.unionByName, parts)


def bundle(runs: DataFrame, metrics: DataFrame, meta: dict[str, str]) -> dict[str, DataFrame]:
    """The artefacts of a report.

    ``runs``: parser, document_id, status, error, parsed, route_expected, route_actual, run_seq, labelled, and what
    ``score.dimensions`` and ``score.per_document_report`` need. ``metrics``: see ``score.dimensions``.
    """
    scores = staged(score.parser_scores(metrics, runs), "scores")
    firsts = staged(score.first_routes(runs), "routes")  # a row per pair of routes; confusion and evidence read it
    confusion = score.confusion(firsts)
    failures = runs.where("status <> 'ok'").select("parser", "document_id", "error")
    told = summary(meta, scores, confusion, failures, score.evidence_of(firsts))
    return {"runs": runs, "levels": levels(metrics), "scores": scores, "confusion": confusion, "failures": failures, "per_document": score.per_document_report(runs, metrics), "summary": told}


def _digest(rows: DataFrame) -> list[Column]:
    """``n`` rows and the sum ``h`` of their hashes, of all columns as text; null is empty."""
    text = F.array_join(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)), "\x1f")
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("h")]


def digest(rows: DataFrame, name: str) -> DataFrame:
    """One row by which an artefact can be compared with the table behind it (see ``write``)."""
    rows = json_lines(rows) if ARTEFACTS[name] == "json" else rows
    return rows.agg(*_digest(rows))


def write(tables: dict[str, DataFrame], root: str, run_id: str) -> dict[str, tuple]:
    """All artefacts, then the list of them; gives the ``digest`` of each table, taken as its rows go to the file.

    A run that is written again is replaced; its list goes first. Files are compressed, and those with many rows are several,
    so that many tasks can read them.
    """
    spark = next(iter(tables.values())).sparkSession
    place = f"{root.rstrip('/')}/{run_id}"
    spark.createDataFrame([], "artefact string, form string").write.mode("overwrite").json(f"{place}/{CONTENTS}")
    told = {}
    for name, rows in tables.items():
        seen, form = Observation(), ARTEFACTS[name]
        if form == "json":
            rows = json_lines(rows)
        elif form == "csv":
            rows = rows.orderBy("parser", "document_id")
        else:
            rows = rows.orderBy("section", "part", "place").select("line")
        writer = rows.observe(seen, *_digest(rows)).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS)
        writer.option("header", True).csv(f"{place}/{name}") if form == "csv" else writer.text(f"{place}/{name}")
        told[name] = (seen.get["n"], seen.get["h"])
    spark.createDataFrame([(n, ARTEFACTS[n]) for n in tables], "artefact string, form string").coalesce(1).write.mode("overwrite").json(f"{place}/{CONTENTS}")
    return told


def read(spark: SparkSession, root: str, run_id: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """An artefact of a finished run; ``schema`` for those in JSON. A run without its list is an error."""
    place = f"{root.rstrip('/')}/{run_id}"
    try:
        listed = spark.read.schema("artefact string, form string").json(f"{place}/{CONTENTS}").where(F.col("artefact") == name).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = 0
    if not listed:
        raise FileNotFoundError(f"run {run_id} has no {name}, or is not finished")
    if ARTEFACTS[name] == "json":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{place}/{name}")
    return spark.read.option("header", True).csv(f"{place}/{name}") if ARTEFACTS[name] == "csv" else spark.read.text(f"{place}/{name}")
