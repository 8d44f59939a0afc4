"""Structure, fields, normalization, routing, validation on small documents with known results."""

import datetime as dt

from pyspark.sql import functions as F

from parchment.functions.text import has_text
from parchment.operators import fields, metrics, normalize, queue, routing, schemas, score, store, structure, validate
from parchment.plans import notices
from parchment.sources import providers

LINES = [
    (1, "header", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"), (1, "paragraph", "UBND HUYỆN ABC"), (1, "paragraph", "Số: 57/QĐ-UBND"), (1, "paragraph", "Hà Nội, ngày 5 tháng 6 năm 2024"),
    (1, "unknown", "QUYẾT ĐỊNH"), (1, "paragraph", "Về việc phê duyệt kế hoạch."), (1, "unknown", "Chương I. Chung"), (1, "unknown", "Điều 1. Phạm vi"), (1, "paragraph", "1. Khoản một"),
    (1, "paragraph", "a) Điểm a"), (1, "paragraph", "Lời thường"), (1, "unknown", "Điều 1. Lặp lại"), (2, "paragraph", "A | B | C"), (2, "paragraph", "1 | 2"), (2, "paragraph", "x | y |"),
    (2, "paragraph", "một | hàng | lẻ"), (2, "footer", "trang 2"), (2, "unknown", "Phụ lục II. Bảng"), (2, "unknown", "Điều 3. Sau phụ lục"), (2, "paragraph", "Hoàn thành trước ngày 1 tháng 7 năm 2024."),
    (2, "unknown", "Nơi nhận:"), (2, "paragraph", "- Như Điều 3"), (2, "paragraph", "TM. ỦY BAN NHÂN DÂN"), (2, "paragraph", "CHỦ TỊCH"), (2, "paragraph", "Nguyễn Văn An"), (2, "paragraph", "1. Sau chữ ký"),
]


def blocks(spark, lines=LINES, document="d"):
    rows = [(document, p, f"b{i}", k, x, i, None, None, None, "x", None) for i, (p, k, x) in enumerate(lines)]
    return spark.createDataFrame(rows, schemas.BLOCKS)


def test_structure(spark):
    found = structure.structure(blocks(spark))
    by = {r.block_id: r for r in found.collect()}
    assert [by[f"b{i}"].node_id for i in (6, 7, 8, 9, 11, 17, 18, 20)] == ["h_chapter_1", "h_article_1", "h_clause_1_1", "h_point_1_1_a", "h_article_1_1", "h_appendix_1", "h_article_3", "h_recipients_1"]
    assert by["b10"].parent_id == "h_point_1_1_a" and by["b21"].admin_role == "recipient" and by["b21"].parent_id == "h_recipients_1"
    assert by["b4"].type == "title" and by["b25"].admin_role == "ordered_list_item" and by["b25"].parent_id is None
    assert (by["b12"].type, by["b13"].type, by["b12"].parent_id) == ("paragraph", "paragraph", None) or by["b12"].type == "table"
    nodes = {r.node_id: r for r in structure.hierarchy(found).collect()}
    assert nodes["h_article_3"].parent_id == "h_appendix_1" and nodes["h_appendix_1"].ordinal == 2 and nodes["h_clause_1_1"].text == "Khoản một"
    assert nodes["h_point_1_1_a"].source_block_ids == ["b9", "b10"]


def test_row_runs(spark):
    lines = [(1, "paragraph", "A | B | C"), (1, "paragraph", "1 | 2 |"), (2, "paragraph", "x | y | z"), (2, "paragraph", "Điều 1. X"), (2, "paragraph", "m | n | o"), (2, "paragraph", "p | q | r | s")]
    found = structure.row_tables(structure.structure(blocks(spark, lines))).orderBy("table_id").collect()
    assert [(r.table_id, r.block_id, r.n_rows, r.n_cols) for r in found] == [("t_admin_1_0001", "b0", 2, 3), ("t_admin_2_0002", "b4", 2, 4)]
    assert found[1].cells == [["m", "n", "o", ""], ["p", "q", "r", "s"]]


def test_fields(spark):
    got = {r.name: r for r in fields.extract(blocks(spark)).collect()}
    assert {k: r.normalized_value for k, r in got.items()} == {
        "document_number": "57/QĐ-UBND", "document_type": "quyet_dinh", "issuer": "UBND HUYỆN ABC", "issue_date": "2024-06-05", "title": "phê duyệt kế hoạch", "signer": "Nguyễn Văn An", "deadline": "2024-07-01",
    }
    assert got["document_number"].field_id == "field_document_number_1" and got["deadline"].confidence == 0.9


def test_conflicting_numbers_need_review(spark):
    lines = [(1, "paragraph", "Số: 1/QĐ"), (1, "paragraph", "Số: 2/QĐ"), (1, "paragraph", "theo ngày 1 tháng 1 năm 2020")]
    got = {r.name: r for r in fields.extract(blocks(spark, lines)).collect()}
    assert got["document_number"].confidence == 0.6 and got["document_number"].review_status == "needs_review" and got["document_number"].normalized_value == "1/QĐ"
    assert "issue_date" not in got


def test_title_after_heading(spark):
    lines = [(1, "paragraph", "QUYẾT ĐỊNH"), (1, "paragraph", "Số: 5/QĐ"), (1, "paragraph", "Ban hành quy chế.")]
    got = {r.name: r.normalized_value for r in fields.extract(blocks(spark, lines)).collect()}
    assert got["title"] == "Ban hành quy chế"


def test_quality_and_validation(spark):
    b = blocks(spark)
    found = structure.structure(b)
    nodes = structure.hierarchy(found)
    q = fields.quality(b, fields.extract(b), nodes).first()
    assert q.structure_quality_score == 1.0 and q.critical_field_warnings == []
    assert validate.documents(found, nodes, structure.row_tables(found), fields.extract(b)).count() == 0
    broken = b.withColumn("parent_id", F.lit("nowhere"))
    assert {r.rule for r in validate.documents(broken, nodes, structure.row_tables(found), fields.extract(b)).collect()} == {"block_parent_missing"}


def test_empty_tables(spark):
    none = blocks(spark).where("false")
    assert fields.extract(none).count() == structure.hierarchy(structure.structure(none)).count() == 0


def test_normalize(spark):
    rows = [("d", 1, 595.0, 842.0, 0, i, f"p{i}", k, x, box, c, None, cells, None) for i, (k, x, box, c, cells) in enumerate([("text", "b", [10.0, 500.0, 20.0, 510.0], 1.5, None), ("Text", "a", [10.0, 100.0, 20.0, 110.0], None, None), ("text", "top", [0.0, 5.0, 9.0, 20.0], -1.0, None), ("table", "", [0.0, 600.0, 9.0, 620.0], None, [["x", "y"], ["z"]])])]
    out = normalize.normalize(spark.createDataFrame(rows, schemas.PROVIDER_BLOCKS))
    got = out.orderBy("reading_order").collect()
    assert [(r.text, r.type, r.block_id) for r in got] == [("top", "header", "b_1_0000"), ("a", "paragraph", "b_1_0001"), ("b", "paragraph", "b_1_0002"), ("", "table", "b_1_0003")]
    assert got[2].confidence == 1.0 and got[0].confidence == 0.0 and got[0].order_strategy == "geometry_top_left"
    table = normalize.tables(out).first()
    assert (table.table_id, table.n_rows, table.n_cols, table.cells) == ("t_1_0001", 2, 2, [["x", "y"], ["z", ""]])


def test_routes(spark):
    long, bad = "chữ " * 40, "ÿþð" * 40
    rows = [("text", 1, long), ("bad", 1, bad), ("bad", 2, long), ("mix", 1, long), ("mix", 2, ""), ("scan", 1, "")]
    pages = spark.createDataFrame([(d, n, x, 0.9 if d == "scan" else 0.0, 0) for d, n, x in rows], "document_id string, page_number int, text string, image_area_ratio double, rotation int")
    got = {r.document_id: (r.route, r.route_confidence) for r in routing.routes(routing.page_signals(pages)).collect()}
    assert got == {"text": ("born_digital", 1.0), "bad": ("garbled_text_layer", 0.75), "mix": ("mixed", 1.0), "scan": ("scanned", 1.0)}


def test_strategy(spark):
    docs = spark.createDataFrame([("a", "scanned"), ("b", "born_digital"), ("c", "encrypted")], "document_id string, route string")
    got = {r.document_id: r for r in routing.select_parser(docs).collect()}
    assert got["a"].degraded and got["a"].capability_gaps == ["ocr"] and got["c"].error_code == "unsupported_input"
    assert {r.error_code for r in routing.select_parser(docs, environment="production").collect()} == {"parser_strategy_undecided", "unsupported_input"}


def test_metrics(spark):
    b = blocks(spark, [(1, "heading", "Một"), (1, "list_item", "hai"), (1, "paragraph", "ba bốn"), (1, "list_item", "năm")])
    truth = spark.createDataFrame([("d", 1, {}, ["Một", "ba bốn", "hai", "thiếu"], [(1, "một")], [["năm", "hai"]], [], ["chân trang"], {"1": "Một hai ba bốn năm"})], schemas.TRUTH)
    got = {r.name: r.value for r in metrics.evaluate(b, spark.createDataFrame([], schemas.TABLES), truth).collect()}
    assert got["word_accuracy"] == 1.0 and got["heading_hierarchy_f1"] == 1.0 and got["header_footer_leakage"] == 1.0
    assert abs(got["reading_order_accuracy"] - 0.75 * 2 / 3) < 1e-9 and got["list_preservation"] == 0.5 and got["table_structure_score"] is None


def test_scores(spark):
    m = spark.createDataFrame([("p", "d", "reading_order_accuracy", 0.5, True, "scanned"), ("p", "d", "provenance_completeness", 1.0, True, "scanned"), ("p", "d", "word_accuracy", None, False, "scanned")], "parser string, document_id string, name string, value double, available boolean, route_expected string")
    r = spark.createDataFrame([("p", "d", True, 2.0, False, False, True, [])], "parser string, document_id string, parsed boolean, seconds_per_page double, requires_gpu boolean, benefits_from_gpu boolean, installed boolean, severe_fields array<string>")
    row = score.parser_scores(m, r).first()
    assert row.gate_failures == ["reading_order_corruption"] and row.disqualified and abs(row.coverage - 0.55) < 1e-9
    assert abs(row.weighted_score - (0.3 * 0.75 + 0.1 * 0.75 + 0.1 + 0.05) / 0.55) < 1e-9


def test_moves():
    assert all(t in queue.DOCUMENT_MOVES for ts in queue.DOCUMENT_MOVES.values() for t in ts)
    assert queue.JOB_MOVES["SUCCEEDED"] == ()


def test_enqueue_reuses_live_jobs(spark):
    jobs = spark.createDataFrame([("a", "a:parse:v1", "FAILED_TERMINAL"), ("a", "a:parse:v1#1", "QUEUED"), ("b", "b:parse:v1", "SUCCEEDED")], "document_id string, idempotency_key string, status string")
    wanted = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "document_id string, next_version int")
    got = {r.document_id: (r.idempotency_key, r.reused) for r in queue.enqueue(wanted, jobs).collect()}
    assert got == {"a": ("a:parse:v1#1", True), "b": ("b:parse:v1#1", False), "c": ("c:parse:v1", False)}


def test_paths(spark):
    rows = spark.createDataFrame([("local://ab/cd/x.bin",), ("local://../x",), ("s3://x",), ("local:///etc",)], "p string")
    assert [r.x for r in rows.select(store.is_safe_path(F.col("p")).alias("x")).collect()] == [True, False, False, False]


def test_providers(spark):
    import json

    payloads = {
        "mineru": {"pdf_info": [{"page_idx": 0, "page_size": [600, 800], "para_blocks": [{"type": "title", "bbox": [1, 2, 3, 4], "score": 0.5, "lines": [{"spans": [{"content": "a"}, {"content": "b"}]}, {"spans": [{"content": "c"}]}]}]}]},
        "marker": {"children": [{"bbox": [0, 0, 100, 200], "page_size": [50, 100], "children": [{"block_type": "Text", "html": "h", "polygon": [[10, 20], [30, 20], [30, 40], [10, 40]]}]}]},
        "docling": {"pages": {"1": {"page_no": 1, "size": {"width": 600, "height": 800}}}, "texts": [{"label": "text", "text": "t", "prov": [{"page_no": 1, "bbox": {"l": 1, "t": 700, "r": 3, "b": 690}, "charspan": [7, 9]}]}], "tables": [{"label": "table", "prov": [{"page_no": 1}], "data": {"grid": [[{"text": "x"}]]}}], "pictures": []},
        "ppstructure": [{"page_index": 0, "input_img_size": [100, 200], "parsing_res_list": [{"block_label": "text", "block_content": "p", "block_bbox": [1, 2, 3, 4], "block_score": 0.9}]}],
    }
    got = {}
    for name, value in payloads.items():
        rows = spark.createDataFrame([("d", json.dumps(value))], "document_id string, value string").select("document_id", F.from_json("value", providers.DIALECTS[name]).alias("payload"))
        got[name] = providers.CONVERTERS[name](rows).orderBy("position").collect()
    assert got["mineru"][0].text == "ab\nc" and got["mineru"][0].provider_block_id == "mineru-1-0" and got["mineru"][0].width == 600
    assert got["marker"][0].bbox == [5.0, 10.0, 15.0, 20.0] and got["marker"][0].text == "h"
    assert got["docling"][0].bbox == [1.0, 100.0, 3.0, 110.0] and got["docling"][0].order_hint == 7 and got["docling"][1].cells == [["x"]]
    assert got["ppstructure"][0].bbox == [1.0, 2.0, 3.0, 4.0] and got["ppstructure"][0].width == 100


def test_routes_in_rows_are_those_of_pages(spark):
    texts = [["x" * 80, "y" * 90], ["x" * 80, "", None], ["\u4e00" * 80, "\u4e00" * 70, "a"], [" a "], ["x" * 60, "b", "\u4e00" * 60]]
    documents = spark.createDataFrame([(str(i), p, i) for i, p in enumerate(texts)], "document_id string, lines array<string>, pages int")
    exploded = documents.select("document_id", F.posexplode("lines").alias("i", "text")).select("document_id", (F.col("i") + 1).alias("page_number"), "text", F.lit(0.0).alias("image_area_ratio"), F.lit(0).alias("rotation"))
    names = ["document_id", "pages", "text_ratio", "garbled_ratio", "sparse_ratio", "mean_chars", "route", "route_confidence", "route_warnings", "text_quality_score", "rotated_pages"]
    one, other = ({r.document_id: r for r in rows.select(names).collect()} for rows in (routing.routes_in_rows(documents, "lines"), routing.routes(routing.page_signals(exploded))))
    assert one == other
    none = routing.routes_in_rows(documents.withColumn("lines", F.lit(None).cast("array<string>")).limit(1), "lines").first()
    assert (none.pages, none.route, none.route_confidence) == (0, "unsupported", 1.0)


def test_inspection(spark):
    """Budgets, image areas, marks and pages that are not composed."""
    rows = [("a", 1, "é" * 70, 0, 10.0, 10.0, [50.0, 10.0]), ("a", 2, "e\u0301" + "x" * 70, 90, 10.0, 10.0, [200.0]), ("a", 3, None, 0, 0.0, 0.0, None), ("b", 1, "x" * 80, 0, 10.0, 10.0, [])]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string, rotation int, width double, height double, images array<double>")
    got = {r.document_id: r for r in routing.inspect(pages, max_pages=2, max_images=1).collect()}
    a, b = got["a"], got["b"]
    assert (a.page_count, a.inspected_page_count, a.pages_with_diacritics, a.image_count, a.rotated_pages, a.non_nfc_pages, a.route) == (3, 2, 2, 2, [2], [2], "born_digital")
    assert a.inspection_warnings == ["routing sampled the first 2 of 3 pages", "rotated pages detected: [2]", "text layer is not NFC-normalized on pages [2]"] and b.inspection_warnings == []
    assert routing.inspect(pages.limit(0)).count() == 0


def test_bad_boxes_fail_their_document_only(spark):
    rows = [("a", 1, 0, [1.0, 2.0]), ("a", 2, 1, [1.0, 2.0, 3.0]), ("b", 1, 0, [0.0, 0.0, 1.0, 1.0]), ("c", 1, 0, None), ("d", 1, 3, [0.0, None, 1.0, 1.0])]
    blocks = spark.createDataFrame(rows, "document_id string, page_number int, position int, bbox array<double>")
    got = {r.document_id: r.error for r in normalize.errors(blocks).collect()}
    assert set(got) == {"a", "d"} and got["a"].message == "2 box(es) without four numbers, the first in block 0 of page 1" and got["a"].code == "normalization_failure" and not got["a"].retryable


def test_failures_before_parsing_and_kept_errors(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("1", 0, "provider_failure", "lost", True), ("2", 2, "provider_failure", "again", False), ("3", 0, "unsupported_input", "no file", True), ("4", 0, None, None, False)]
    jobs = spark.createDataFrame(rows, "id string, attempt int, error_code string, error_message string, before_parsing boolean").withColumns({"leased_by": F.lit("w"), "lease_expires_at": F.lit(at), "available_at": F.lit(None).cast("timestamp")})
    got = {r.id: r for r in queue.run_leased(jobs, F.lit(at)).collect()}
    assert [got[i].document_walk for i in "1234"] == [["INSPECTING", "QUEUED_FOR_PARSE"], ["INSPECTING", "PARSING", "PARSE_FAILED"], ["INSPECTING", "PARSE_FAILED"], ["INSPECTING", "PARSING", "NORMALIZING", "STRUCTURING", "READY_FOR_REVIEW"]]
    assert [(got[i].job_error and (got[i].job_error.code, got[i].job_error.message, got[i].job_error.retryable)) for i in "1234"] == [("provider_failure", "lost", True), ("provider_failure", "again", True), ("unsupported_input", "no file", False), None]
    assert [(got[i].document_error_code, got[i].document_error_message) for i in "34"] == [("unsupported_input", "no file"), (None, None)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_sort_and_no_shuffle_of_blocks(spark, tmp_path):
    """Blocks made from orders come partitioned by document; structure and fields then sort them once and do not move them."""
    at = dt.datetime(2024, 1, 2)
    spark.createDataFrame([(1, 2, at, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 1, 5, 3.0, at)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = notices.blocks(spark, str(tmp_path))
    for plan in (_plan(structure.structure(made)), _plan(fields.prepare(made))):
        assert plan.count("Exchange hashpartitioning(document_id") == 1 and sum("Sort [document_id" in x for x in plan.split("\n")) == 1


def test_dangling_references_are_grouped_without_a_join(spark):
    rows = spark.createDataFrame([("d", "a", "b"), ("d", "x", "a"), ("d", "x", None), ("e", "b", "c"), (None, "n", "n"), ("d", None, "q")], "document_id string, ref string, key string")
    other = rows.select("document_id", "key")
    for targets in (rows, other):
        out = validate.dangling(rows, "ref", targets, "key", "r")
        assert sorted(map(tuple, out.collect()), key=str) == sorted([("r", "d", "x"), ("r", "d", "x"), ("r", "e", "b"), ("r", None, "n")], key=str)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_table_cells_of_both_sides_are_counted_in_one_grouping(spark):
    cells = "array<array<string>>"
    truth = spark.createDataFrame([("a", [(1, [["x", "X"], ["y", None]])]), ("b", [(1, [])]), ("c", [(1, [["q"]])])], f"document_id string, tables array<struct<page_number:int,cells:{cells}>>")
    own = spark.createDataFrame([("a", 1, "t", 2, 2, [["x", "x"], ["z", None]]), ("a", 1, "u", 1, 1, [["y"]]), ("b", 1, "t", 1, 1, [["x"]]), ("c", 2, "t", 1, 1, [["q"]])], f"document_id string, page_number int, table_id string, n_rows int, n_cols int, cells {cells}")
    out = metrics.table_structure(own, truth)
    assert {r.document_id: r.value for r in out.collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_has_text_ends_at_the_first_character(spark):
    rows = spark.createDataFrame([(0, " \x1c"), (1, " a"), (2, ""), (3, None)], "i int, x string")
    assert [r.y for r in rows.select("i", has_text(F.col("x")).alias("y")).orderBy("i").collect()] == [False, True, False, None]


def test_fields_are_taken_in_one_grouping(spark):
    """Nothing is written or joined between the lines of a document and its fields, and blocks move once."""
    plan = _plan(fields.extract(blocks(spark)))
    assert "FileScan" not in plan and "Join" not in plan and plan.count("Exchange ") == 1


def test_other_numbers_and_dates_lower_the_confidence(spark):
    lines = [(1, "paragraph", "Số: 1/QĐ"), (1, "paragraph", "Số: 2/QĐ"), (2, "paragraph", "Số: 1/QĐ"), (1, "paragraph", "Huế, ngày 1 tháng 2 năm 2020"), (1, "paragraph", "Huế, ngày 3 tháng 2 năm 2020 và 1/2/2020"), (2, "paragraph", "theo 4/5/2020")]
    got = {r.name: r for r in fields.extract(blocks(spark, lines)).collect()}
    assert (got["document_number"].normalized_value, got["document_number"].confidence, got["document_number"].source_block_ids) == ("1/QĐ", 0.6, ["b0"])
    assert (got["issue_date"].normalized_value, got["issue_date"].confidence, got["issue_date"].raw_value) == ("2020-02-01", 0.6, "ngày 1 tháng 2 năm 2020")
    same = [(1, "paragraph", "Huế, ngày 1 tháng 2 năm 2020"), (1, "paragraph", "Huế, ngày 1 tháng 2 năm 2020")]
    assert fields.extract(blocks(spark, same)).first().confidence > 0.75


def test_walk_over_batches(spark):
    """Tables, open levels and ids go on over the batches of the fold, and end with the document."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = [(1, "paragraph", "Điều 1. X"), (1, "paragraph", "1. Một"), (1, "paragraph", "A | B | C"), (1, "paragraph", "1 | 2 | 3"), (1, "paragraph", "x | y | z"), (2, "paragraph", "p | q | r"), (2, "paragraph", "1. Một"), (2, "paragraph", "TM. AN"), (2, "paragraph", "2. Hai")]
    two = blocks(spark, lines).unionByName(blocks(spark, lines[2:4], "e"))
    got = []
    for size in (1, 2, 3, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found = structure.structure(two).select("document_id", "block_id", "rule", "table_id", "row_index", "node_id", "above").orderBy("document_id", "block_id").collect()
        got.append(found)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert all(x == got[0] for x in got)
    assert [r.row_index for r in got[0]] == [None, None, 0, 1, 2, None, None, None, None, 0, 1] and {r.table_id for r in got[0]} == {None, "t_admin_1_0001"}
    assert [r.node_id for r in got[0]][:2] == ["h_article_1", "h_clause_1_1"] and got[0][6].node_id == "h_clause_1_1_1" and got[0][8].rule == "ordered" and got[0][2].above == "h_clause_1_1"


def test_ids_of_documents_are_not_broadcast(spark):
    """Documents are merged with their results, though their ids would fit a broadcast by the size of the file."""
    from parchment.operators import ingest

    made = blocks(spark)
    pages = made.select("document_id", "page_number").distinct().select("*", F.lit("x" * 80).alias("text"), F.lit(0.0).alias("image_area_ratio"), F.lit(0).alias("rotation"))
    known = spark.createDataFrame([("d",), ("gone",)], "document_id string")
    out = ingest.run(known, pages, made, {"decided": False, "allow_baseline_when_undecided": True, "routes": {}})
    assert {r.document_id: (r.n_fields, r.error_code, r.requires_user_review, r.critical_field_warnings) for r in out.collect()} == {"d": (7, None, True, []), "gone": (None, "invalid_pdf", None, None)}
    assert "BroadcastHashJoin [document_id" not in _plan(out) and "SortMergeJoin [document_id" in _plan(out)
