"""Streams run to completion on small files; readers and sinks on temporary folders."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from parchment.operators import queue, runs, store
from parchment.operators.staging import staged
from parchment.sources import files, providers
from parchment.streaming import jobs


def collect(query_name, stream, spark):
    q = stream.writeStream.format("memory").queryName(query_name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(query_name).collect()


def test_uploads_and_windows(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", at(1), "x"), ("b", at(1), "y"), ("c", at(2), "x"), ("d", at(9), "z")]
    spark.createDataFrame(rows, "id string, created_at timestamp, content string").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = "id string, created_at timestamp, content string"
    got = collect("uploads", jobs.new_uploads(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), spark)
    assert sorted(r.content for r in got) == ["x", "y", "z"]
    counts = collect("counts", jobs.event_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "created_at", "content"), spark)
    assert {(r.window_start.hour, r.content, r.n) for r in counts} >= {(1, "x", 1), (1, "y", 1), (2, "x", 1)}


def test_leases(spark, tmp_path):
    rows = [("a", "LEASED", 0.0), ("a", "RUNNING", 100.0), ("a", "SUCCEEDED", 900.0), ("b", "LEASED", 10.0), ("c", "QUEUED", 5.0), ("d", "LEASED", 10_000.0)]
    spark.createDataFrame(rows, "job_id string, status string, at double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id string, status string, at double").parquet(f"{tmp_path}/in")
    got = {(r.job_id, r.status, r.changed_at) for r in collect("leases", jobs.lease_states(stream), spark)}
    assert {("a", "QUEUED", 400.0), ("a", "SUCCEEDED", 900.0), ("b", "LEASED", 10.0), ("c", "QUEUED", 5.0)} <= got


def test_drain_is_idempotent(spark, tmp_path):
    rows = [("1", "d", "critical_field_correction", "f", "v1", None, dt.datetime(2024, 1, 1)), ("2", "d", "critical_field_correction", "f", "v2", None, dt.datetime(2024, 1, 2))]
    schema = "id string, document_id string, feedback_type string, field_id string, corrected_value string, comment string, created_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        jobs.drain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), jobs.fold_corrections(f"{tmp_path}/out"), f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [r.corrected_value for r in jobs.current_corrections(spark, f"{tmp_path}/out").collect()] == ["v2"]


def test_manifest(spark, tmp_path):
    entry = {"document_id": "a", "path": "x.pdf", "route_label": "scanned", "difficulty": "easy", "provenance": "made"}
    lines = ["# comment", "", json.dumps(entry), json.dumps(entry | {"document_id": "b", "odd": 1}), json.dumps(entry | {"document_id": "c", "ground_truth": "t.json"}), json.dumps(entry | {"document_id": "c"}), "{broken", "[1]", json.dumps(entry | {"document_id": "e", "notes": {"x": 1}, "path": ""}), json.dumps(entry | {"document_id": "f", "route_label": "wavy"})]
    (tmp_path / "m.jsonl").write_text("\r\n".join(lines))
    rows = files.read_manifest(spark, str(tmp_path / "m.jsonl"))
    got = sorted((r.line_number, r.document_id or "", r.problem or "", r.problem_detail or "") for r in rows.collect())
    assert got == [(3, "a", "", ""), (4, "b", "unknown_keys", "odd"), (5, "c", "", ""), (6, "c", "duplicate_id", "c"), (7, "", "malformed", ""), (8, "", "malformed", ""), (9, "e", "missing_keys", "path"), (10, "f", "unknown_label", "wavy")]
    (tmp_path / "none.jsonl").write_text("# nothing\n\n")
    assert [r.problem for r in files.read_manifest(spark, str(tmp_path / "none.jsonl")).collect()] == ["no_entries"]


def test_manifest_audit(spark):
    rows = [("a", "/data/a.pdf", "made", None), ("b", "/repo/x/../b.pdf", "private", None), ("c", "/repo/../out/c.pdf", "private", "c.json"), ("d", "d.pdf", "made", "/t/d.json"), ("e", "e.pdf", "made", "/t/e.json"), ("f", "f.pdf", "made", "/t/f.json")]
    manifest = spark.createDataFrame(rows, "document_id string, path string, provenance string, ground_truth string")
    known = spark.createDataFrame([(p,) for p in ("/data/a.pdf", "/repo/x/../b.pdf", "/repo/../out/c.pdf", "d.pdf", "e.pdf", "f.pdf", "/t/d.json", "/t/e.json", "/t/f.json")], "path string")
    truth = spark.createDataFrame([("/t/d.json", "d"), ("/t/e.json", "other"), ("/t/f.json", None)], "path string, document_id string")
    got = {(r.document_id, r.problem, r.detail) for r in files.audit_manifest(manifest, known, truth, root="/x/../repo").collect()}
    assert got == {("b", "private_path_inside", "/repo/x/../b.pdf"), ("c", "private_path_relative", "c.json"), ("c", "missing_truth", "c.json"), ("e", "truth_of_another", "other"), ("f", "invalid_truth", "/t/f.json")}
    paths = spark.createDataFrame([("/a/./b//c/../d",), ("/../..",), ("/a/b/../../../x",), (None,)], "p string")
    assert [r.r for r in paths.select(files.resolved(F.col("p")).alias("r")).collect()] == ["/a/b/d", "/", "/x", None]


def test_truth_files(spark, tmp_path):
    truth = {"document_id": "a", "page_count": 2, "headings": [{"level": 1, "text": "x"}], "transcript": {"1": "t"}}
    for name, text in {"good": json.dumps(truth), "key": json.dumps(truth | {"odd": 1}), "type": json.dumps(truth | {"page_count": "two"}), "cut": '{"document_id"', "none": "{}"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_truth(spark, str(tmp_path)).collect()}
    assert {n: r.document_id for n, r in got.items()} == {"good.json": "a", "key.json": None, "type.json": None, "cut.json": None, "none.json": None}
    assert got["good.json"].page_count == 2 and got["good.json"].headings[0].text == "x" and got["good.json"].transcript == {"1": "t"}


def test_line_numbers_over_splits(spark, tmp_path):
    """A file in many splits, another in one; numbers start anew in each."""
    lines = [f"{i} " + "x" * (i % 50) for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("one\n\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path))
        assert rows.where("path like '%a.txt'").select("path").count() == 2000
        got = {(r.path[-5:], r.line_number): r.line for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.txt", i + 1): line for i, line in enumerate(lines)} | {("b.txt", 1): "one", ("b.txt", 2): "", ("b.txt", 3): "two"}


def test_originals(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "pdf" / "big.pdf").write_bytes(b"0" * 100)
    got = files.read_originals(spark, f"{tmp_path}/pdf", limit=50).collect()
    assert [(r.head, r.byte_size) for r in got] == [("%PDF-", 10)]
    assert providers.adapters(spark).where("readable").count() == 4


def test_recordings(spark, tmp_path):
    (tmp_path / "mineru").mkdir(parents=True)
    page = {"page_number": 1, "width": 10, "height": 20, "rotation": 0, "blocks": [{"provider_block_id": "x", "provider_type": "text", "text": "t", "bbox": [0, 0, 1, 1], "attributes": {"cells": [["c"]]}}]}
    for name, text in {"d": json.dumps({"document_id": "d", "pages": [page]}), "e": json.dumps({"document_id": "other", "pages": [page]}), "cut": '{"document_id": "cut', "no id": "{}", "empty": ""}.items():
        (tmp_path / "mineru" / f"{name}.json").write_text(text)
    (tmp_path / "mineru" / "notes.txt").write_text("no recording")
    catalogue = providers.recordings(spark, str(tmp_path))
    assert {r.document_id for r in catalogue.collect()} == {"d", "e", "cut", "no id"}
    health = {r.name: (r.available, r.recordings, r.detail) for r in providers.recording_health(spark, catalogue).collect()}
    assert health["mineru+recorded"] == (True, 4, "") and health["docling+recorded"] == (False, 0, "no recordings for docling")
    asked = spark.createDataFrame([("mineru+recorded", d) for d in ("d", "e", "cut", "no id", "empty", "none", "d")] + [("mineru", "d"), ("strange+recorded", "d")], "parser string, document_id string")
    rows = providers.replay(asked, catalogue, str(tmp_path))
    got = sorted((r.parser, r.document_id, r.error and r.error.code) for r in rows.collect())
    m = "mineru+recorded"
    assert got == sorted([(m, "d", None), (m, "d", None), (m, "e", "provider_failure"), (m, "cut", "provider_failure"), (m, "no id", "provider_failure"), (m, "empty", "recording_missing"), (m, "none", "recording_missing"), ("mineru", "d", "unsupported_input"), ("strange+recorded", "d", "unsupported_input")], key=lambda x: (x[0], x[1], x[2] or ""))
    missing = rows.where("document_id = 'none'").first().error
    assert missing.details == {"expected_path": f"{tmp_path}/mineru/none.json"} and missing.parser_name == m and not missing.retryable
    assert [(r.document_id, r.text, r.cells) for r in providers.recorded_blocks(rows).collect()] == [("d", "t", [["c"]])] * 2


def test_write_once(spark, tmp_path):
    def put(batch, rows):
        table = spark.createDataFrame([(u, c, 1) for u, c in rows], "uri string, content binary, outcome int")
        return sorted((r.uri or "", r.outcome) for r in store.put_once(table, f"{tmp_path}/o", batch).collect())

    assert store.stored(spark, f"{tmp_path}/o") is None
    first = [("a", b"1"), ("b", b"2"), ("b", b"2"), ("c", b"3"), ("c", b"4"), (None, b"5"), ("d", None)]
    expected = [("", "empty"), ("a", "stored"), ("b", "stored"), ("b", "stored"), ("c", "clash"), ("c", "clash"), ("d", "empty")]
    assert put("one", first) == expected == put("one", first)  # a retried batch writes the same again
    assert put("two", [("a", b"1"), ("b", b"x"), ("c", b"3")]) == [("a", "already_stored"), ("b", "clash"), ("c", "stored")]
    assert put("three", []) == []
    assert sorted((r.uri, bytes(r.content), r.batch) for r in store.stored(spark, f"{tmp_path}/o").collect()) == [("a", b"1", "one"), ("b", b"2", "one"), ("c", b"3", "two")]
    with pytest.raises(ValueError):
        store.put_once(spark.createDataFrame([], "uri string, content binary"), str(tmp_path), "../x")


def test_drain_passes_end_like_a_loop(spark):
    """Passes of two jobs until nothing runs, against a loop over plain rows."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    status = ["QUEUED", "QUEUED", "LEASED", "RUNNING", "SUCCEEDED", "QUEUED", "LEASED"]
    expires = [None, None, at(1), None, None, None, at(59)]
    rows = [(str(i), "d", s, 0, None, e, None, at(9 - i)) for i, (s, e) in enumerate(zip(status, expires, strict=True))]
    schema = "id string, document_id string, status string, attempt int, leased_by string, lease_expires_at timestamp, available_at timestamp, created_at timestamp"
    jobs_, now = spark.createDataFrame(rows, schema), F.lit(at(30))
    run = lambda leased: leased.withColumn("error_code", F.when(F.col("id") == "1", "provider_failure").when(F.col("id") == "2", "invalid_pdf"))
    taken = []
    for _ in range(4):
        after = queue.drain_pass(jobs_, run, now, max_jobs=2)
        taken.append([r.id for r in after.where("ran").orderBy("created_at").collect()])
        jobs_ = staged(after.select(*jobs_.columns), "jobs")
    assert taken == [["5", "3"], ["2", "1"], ["0"], []]
    got = {r.id: (r.status, r.attempt, r.leased_by) for r in jobs_.collect()}
    assert got == {"0": ("SUCCEEDED", 1, None), "1": ("QUEUED", 1, None), "2": ("FAILED_TERMINAL", 1, None), "3": ("SUCCEEDED", 1, None), "4": ("SUCCEEDED", 0, None), "5": ("SUCCEEDED", 1, None), "6": ("LEASED", 0, None)}
    assert {r.id for r in queue.drain_pass(jobs_, run, F.lit(at(31))).where("ran").collect()} == {"1"}  # its backoff is over


def test_runs_are_isolated(spark):
    def parse(payload):
        if payload is None:
            raise runs.ParserFailure("provider_failure", "nothing", retryable=True, details={"k": "v"})
        if payload == "slow":
            try:
                while True:
                    time.sleep(0.01)
            except Exception:  # noqa: BLE001 - a parser that catches what it can
                return {}
        return {"n": len(payload), "é": [1]}

    pairs = spark.createDataFrame([("p", "a", "xy", 1.0), ("p", "b", None, 1.0), ("p", "c", "slow", 1.0), ("q", "d", "x", 1.0), ("p", "a", "xy", 1.0)], "parser string, document_id string, payload string, seconds double").coalesce(1)
    got = sorted(runs.run_frame(pairs, {"p": parse}, limit_seconds=0.3).collect(), key=lambda r: r.document_id)
    assert [(r.status, r.error and r.error.code, r.result) for r in got] == [("ok", None, '{"n": 2, "é": [1]}')] * 2 + [("failed", "provider_failure", None), ("failed", "parse_timeout", None), ("failed", "unsupported_input", None)]
    assert got[2].error.retryable and got[2].error.details == {"k": "v"} and got[3].error.retryable and 0.3 <= got[3].seconds < 3
    assert runs.run_frame(pairs.limit(0), {}).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
    assert F.lit(1) is not None
