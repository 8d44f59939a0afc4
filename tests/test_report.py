"""Report bundles: written together, sorted keys, read back; empty and unfinished runs."""

import json

import pytest
from pyspark.sql import functions as F

from parchment.operators import score
from parchment.plans import catalogue
from parchment.sources import report

RUNS = (
    "parser string, document_id string, status string, error struct<code:string,message:string,retryable:boolean,parser_name:string,details:map<string,string>>, parsed boolean, route_expected string, route_actual string, run_seq int, labelled boolean, "
    "seconds_per_page double, requires_gpu boolean, benefits_from_gpu boolean, installed boolean, severe_fields array<string>, page_count int, duration_ms double, peak_rss_mb double, error_code string"
)
METRICS = "parser string, document_id string, route_expected string, name string, value double, available boolean"


def run(parser, document, error=None, route="scanned"):
    return (parser, document, "failed" if error else "ok", error, error is None, route, route if error is None else None, 0, True, 0.5, False, False, True, [], 1, 2.0, None, error and error[0])


@pytest.fixture
def tables(spark):
    runs = spark.createDataFrame([run("p", "a"), run("p", "b", ("bad", None, False, "p", {"z": "1", "a": "2"})), run("q", "a", ("worse", "x | y\nz", True, "q", None))], RUNS)
    metrics = spark.createDataFrame([("p", "a", "scanned", "word_accuracy", 0.5, True), ("p", "a", "scanned", "reading_order_accuracy", None, False), ("q", "a", "scanned", "word_accuracy", 1.0, True)], METRICS)
    return runs, metrics


def test_bundle(spark, tables, tmp_path):
    runs, metrics = tables
    made = report.bundle(runs, metrics, {"run_id": "r", "commit": "c"})
    with pytest.raises(FileNotFoundError):
        report.read(spark, str(tmp_path), "r", "summary")
    for _ in range(2):  # a repeated write replaces
        report.write(made, str(tmp_path), "r")
    lines = [r.value for r in report.read(spark, str(tmp_path), "r", "summary").collect()]
    assert lines[:3] == ["# Run r", "- commit: c", "- run_id: r"] and "| scanned | scanned | 1 |" in lines
    assert "| p | b | bad |  |" in lines and "| q | a | worse | x   y z |" in lines and lines.index("## Failures") < lines.index("| p | b | bad |  |") < lines.index("## Evidence")
    assert any(x.startswith("- Not enough") for x in lines) and sum(x.startswith("- p: scored over") for x in lines) == 1
    failures = [r.value for r in spark.read.text(f"{tmp_path}/r/failures").collect()]
    assert len(failures) == 2 and all(list(json.loads(x)) == ["document_id", "error", "parser"] for x in failures)
    own = next(json.loads(x) for x in failures if '"b"' in x)["error"]
    assert list(own) == ["code", "details", "message", "parser_name", "retryable"] and list(own["details"]) == ["a", "z"] and own["message"] is None
    levels = {(r.level, r.parser, r.name): (r.mean, r.n, r.n_available) for r in made["levels"].collect()}
    assert levels["all", None, None] == (0.75, 3, 2) and levels["parser", "p", None] == (0.5, 2, 1) and levels["metric", None, "word_accuracy"] == (0.75, 2, 2)
    assert report.read(spark, str(tmp_path), "r", "per_document").count() == 3
    with pytest.raises(FileNotFoundError):
        report.read(spark, str(tmp_path), "r", "other")


def test_empty_run(spark, tables, tmp_path):
    runs, metrics = (t.limit(0) for t in tables)
    made = report.bundle(runs, metrics, {})
    report.write(made, str(tmp_path), "none")
    lines = [r.value for r in report.read(spark, str(tmp_path), "none", "summary").collect()]
    assert "## Failures" in lines and "- Documents: 0, with labels: 0" in lines and report.read(spark, str(tmp_path), "none", "confusion", made["confusion"].schema).count() == 0


def test_sorted_keys_of_nested_values(spark):
    rows = spark.sql("select 1 as b, array(named_struct('d', map('y', 1, 'x', 2), 'c', cast(null as string))) as a, cast(null as struct<z:int,y:int>) as n")
    assert report.json_lines(rows).first().value == '{"a":[{"c":null,"d":{"x":2,"y":1}}],"b":1,"n":null}'
    assert rows.where(F.lit(False)).count() == report.json_lines(rows.limit(0)).count()


def test_repeated_runs_in_any_order(spark):
    """A document measured twice has the same report however its rows come."""
    rows = [("p", "a", "scanned", "word_accuracy", 0.5, True), ("p", "a", "scanned", "word_accuracy", 0.75, True)]
    runs = spark.createDataFrame([run("p", "a")], RUNS)
    for order in (rows, rows[::-1]):
        metrics = spark.createDataFrame(order, METRICS).coalesce(1)
        assert [r.word_accuracy for r in score.per_document_report(runs, metrics).collect()] == ["0.7500"]


def test_levels_write_levels_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "staging_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert catalogue.queries()["report_levels"](spark, "/root/testdata/sf0.001").where("level = 'all'").count() == 1
    assert {x.name for x in tmp_path.glob("report/r1/*")} == {"levels", report.CONTENTS}


def test_report_files_whole_and_small(spark, tmp_path, monkeypatch):
    """Every artefact is compared, levels too; files are compressed, and what is made from the table is not written besides."""
    monkeypatch.setattr(catalogue, "staging_path", lambda spark, name: f"file://{tmp_path}/{name}")
    staged = []
    monkeypatch.setattr(catalogue, "staged", lambda rows, name: staged.append(name) or rows)
    got = {r.artefact: (r.n, r.same) for r in catalogue.queries()["report_files"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(report.ARTEFACTS) and all(same for _, same in got.values()) and got["levels"][0] > 1 and not staged
    parts = [x for name in report.ARTEFACTS for x in (tmp_path / "report/r1" / name).glob("part-*")]
    assert {x.parent.name for x in parts} == set(report.ARTEFACTS) and all(x.suffix == ".gz" for x in parts)


def test_changed_file_is_seen(spark, tables, tmp_path):
    runs, metrics = tables
    made = report.bundle(runs, metrics, {})
    told = report.write(made, str(tmp_path), "r")
    for name, (n, h) in told.items():
        rows = made[name].select("line") if name == "summary" else made[name]
        assert report.digest(report.read(spark, str(tmp_path), "r", name, rows.schema), name).first() == (n, h)
    report.json_lines(made["failures"].withColumn("parser", F.lit("z"))).write.mode("overwrite").text(f"{tmp_path}/r/failures")
    assert report.digest(report.read(spark, str(tmp_path), "r", "failures", made["failures"].schema), "failures").first() != told["failures"]


def test_per_document_without_a_join(spark):
    """Repeated runs stay, runs without a key have no values, rows come sorted after one exchange."""
    rows = [("p", "b", "scanned", "word_accuracy", 0.5, True), ("p", "a", "scanned", "word_accuracy", 0.25, True), ("p", "a", "scanned", "word_accuracy", 1.0, False), (None, "a", "scanned", "word_accuracy", 0.75, True), ("p", "lost", "scanned", "word_accuracy", 0.75, True)]
    runs = spark.createDataFrame([run("p", "b"), run("p", "a"), run("p", "a", ("bad", None, False, "p", None)), run(None, "a"), run("", "a")], RUNS)
    made = score.per_document_report(runs, spark.createDataFrame(rows, METRICS)).orderBy("parser", "document_id")
    assert [(r.parser, r.document_id, r.word_accuracy) for r in made.collect()] == [("", "a", ""), ("", "a", ""), ("p", "a", "0.2500"), ("p", "a", "0.2500"), ("p", "b", "0.5000")]
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_routes_and_evidence_in_one_grouping(spark):
    runs = spark.createDataFrame([("a", 1, "x", "y", None), ("a", 0, "x", "z", True), ("b", 0, "x", None, False), ("b", 1, "x", "y", False), (None, 0, "x", "z", True)], "document_id string, run_seq int, route_expected string, route_actual string, labelled boolean")
    firsts = score.first_routes(runs)
    assert score.confusion(firsts).collect() == [("x", "z", 2)] == score.route_confusion(runs.drop("labelled")).collect()
    assert score.evidence_of(firsts).first() == (2, 1, False) == score.evidence(runs).first()
    assert score.evidence_of(firsts.limit(0)).first() == (0, 0, False)
