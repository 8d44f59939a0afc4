"""Provider output in four JSON dialects to provider blocks (see ``operators.schemas.PROVIDER_BLOCKS``).

Each reader takes a table with ``document_id`` and the parsed JSON in ``payload`` (``read`` makes one from files with
the dialect's schema, failing on rows that do not fit). Nothing is inferred, nothing passes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import polygon_box, top_left_box
from ..functions.vocabulary import DEFAULT_HEIGHT, DEFAULT_WIDTH

MIDDLE = (
    "struct<pdf_info:array<struct<page_idx:int,page_size:array<double>,"
    "para_blocks:array<struct<type:string,bbox:array<double>,score:double,index:int,lines:array<struct<spans:array<struct<content:string>>>>,cells:array<array<string>>>>,"
    "preproc_blocks:array<struct<type:string,bbox:array<double>,score:double,index:int,lines:array<struct<spans:array<struct<content:string>>>>,cells:array<array<string>>>>>>>"
)
RENDERED = "struct<children:array<struct<bbox:array<double>,page_size:array<double>,children:array<struct<id:string,block_type:string,text:string,html:string,polygon:array<array<double>>,bbox:array<double>,cells:array<array<string>>>>>>>"
_PROV = "prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>,charspan:array<int>>>"
EXPORTED = (
    f"struct<pages:map<string,struct<page_no:int,size:struct<width:double,height:double>>>,texts:array<struct<self_ref:string,label:string,text:string,{_PROV}>>,"
    f"tables:array<struct<self_ref:string,label:string,text:string,{_PROV},data:struct<grid:array<array<struct<text:string>>>>>>,pictures:array<struct<self_ref:string,label:string,text:string,{_PROV}>>>"
)
PARSED = "array<struct<page_index:int,input_img_size:array<double>,image_size:array<double>,parsing_res_list:array<struct<block_label:string,block_content:string,block_bbox:array<double>,block_score:double,block_cells:array<array<string>>>>>>"
DIALECTS = {"mineru": MIDDLE, "marker": RENDERED, "docling": EXPORTED, "ppstructure": PARSED}


def read(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """One JSON document per file; the document id is the file's name without ``.json``."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("document_id"), "value")
    return rows.select("document_id", F.from_json("value", DIALECTS[dialect], {"mode": "FAILFAST"}).alias("payload"))


def _out(rows: DataFrame, **columns: Column) -> DataFrame:
    given = {"rotation": F.lit(0), "confidence": F.lit(None).cast("double"), "caption": F.lit(None).cast("string"), "cells": F.lit(None).cast("array<array<string>>")} | columns
    order = ("page_number", "width", "height", "rotation", "position", "provider_block_id", "provider_type", "text", "bbox", "confidence", "order_hint", "cells", "caption")
    return rows.select("document_id", *(given[c].alias(c) for c in order))


def _box(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def from_middle(rows: DataFrame) -> DataFrame:
    """Pages with paragraph blocks, else preprocessed ones; lines joined by line ends, spans by nothing."""
    pages = rows.select("document_id", F.posexplode("payload.pdf_info").alias("p", "page"))
    chosen = F.when(F.size("page.para_blocks") > 0, F.col("page.para_blocks")).otherwise(F.col("page.preproc_blocks"))
    blocks = pages.select("document_id", "p", "page", F.posexplode(chosen).alias("i", "b"))
    text = F.array_join(F.transform(F.coalesce("b.lines", F.array()), lambda line: F.array_join(F.transform(F.coalesce(line["spans"], F.array()), lambda s: F.coalesce(s["content"], F.lit(""))), "")), "\n")
    return _out(
        blocks,
        page_number=F.coalesce("page.page_idx", "p") + 1,
        width=F.coalesce(F.get("page.page_size", F.lit(0)), F.lit(DEFAULT_WIDTH)),
        height=F.coalesce(F.get("page.page_size", F.lit(1)), F.lit(DEFAULT_HEIGHT)),
        position=F.col("i"),
        provider_block_id=F.format_string("mineru-%d-%d", F.col("p") + 1, "i"),
        provider_type=F.coalesce("b.type", F.lit("text")),
        text=text,
        bbox=_box(F.col("b.bbox")),
        confidence=F.col("b.score"),
        order_hint=F.coalesce("b.index", "i"),
        cells=F.when(F.col("b.type") == "table", F.col("b.cells")),
    )


def _scaled(box: Column, x: Column, y: Column) -> Column:
    return F.when(box.isNotNull(), F.array(box[0] * x, box[1] * y, box[2] * x, box[3] * y))


def from_rendered(rows: DataFrame) -> DataFrame:
    """Boxes or polygons in pixels, scaled to points where the page tells its size."""
    pages = rows.select("document_id", F.posexplode("payload.children").alias("p", "page"))
    frame = F.when(F.size("page.bbox") == 4, F.col("page.bbox")).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0)))
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    pages = pages.withColumn("frame", frame).withColumns({"pw": one(F.get("frame", F.lit(2)) - F.get("frame", F.lit(0))), "ph": one(F.get("frame", F.lit(3)) - F.get("frame", F.lit(1)))})
    pages = pages.withColumns({"w": F.coalesce(F.get("page.page_size", F.lit(0)), "pw"), "h": F.coalesce(F.get("page.page_size", F.lit(1)), "ph")})
    blocks = pages.select("*", F.posexplode("page.children").alias("i", "b"))
    return _out(
        blocks,
        page_number=F.col("p") + 1,
        width=F.col("w"),
        height=F.col("h"),
        position=F.col("i"),
        provider_block_id=F.coalesce(F.nullif("b.id", F.lit("")), F.format_string("marker-%d-%d", F.col("p") + 1, "i")),
        provider_type=F.coalesce("b.block_type", F.lit("text")),
        text=F.coalesce(F.nullif("b.text", F.lit("")), F.nullif("b.html", F.lit("")), F.lit("")),
        bbox=_scaled(F.coalesce(polygon_box(F.col("b.polygon")), _box(F.col("b.bbox"))), F.col("w") / F.col("pw"), F.col("h") / F.col("ph")),
        order_hint=F.col("i"),
        cells=F.when(F.lower("b.block_type") == "table", F.col("b.cells")),
    )


def from_exported(rows: DataFrame) -> DataFrame:
    """Texts, then tables, then pictures, one row per place; boxes turned to y downwards. One pass over the payload."""
    no_cells = F.lit(None).cast("array<array<string>>")

    def items(kind: str, name: str) -> Column:
        grid = lambda it: F.transform(it["data"]["grid"], lambda r: F.transform(r, lambda c: F.coalesce(c["text"], F.lit(""))))
        return F.transform(
            F.coalesce(F.col(f"payload.{name}"), F.array()),
            lambda it, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), it["self_ref"].alias("ref"), it["label"].alias("label"), it["text"].alias("text"), it["prov"].alias("prov"), (grid(it) if kind == "table" else no_cells).alias("cells")),
        )

    every = rows.select("document_id", F.col("payload.pages").alias("pages"), F.posexplode(F.concat(items("text", "texts"), items("table", "tables"), items("picture", "pictures"))).alias("n", "it"))
    places = every.select("document_id", "pages", "n", "it", F.posexplode("it.prov").alias("j", "prov"))
    number = F.coalesce("prov.page_no", F.lit(1))
    page = F.filter(F.map_entries("pages"), lambda e: F.coalesce(e["value"]["page_no"], e["key"].cast("int")) == number)[0]["value"]["size"]
    places = places.withColumns({"no": number, "w": F.coalesce(page["width"], F.lit(DEFAULT_WIDTH)), "h": F.coalesce(page["height"], F.lit(DEFAULT_HEIGHT))})
    box = F.col("prov.bbox")
    return _out(
        places,
        page_number=F.col("no"),
        width=F.col("w"),
        height=F.col("h"),
        position=F.col("n") * 1000 + F.col("j"),
        provider_block_id=F.coalesce(F.nullif("it.ref", F.lit("")), F.format_string("docling-%s-%d", "it.kind", "it.k")),
        provider_type=F.coalesce("it.label", "it.kind"),
        text=F.coalesce("it.text", F.lit("")),
        bbox=F.when(box.isNotNull(), top_left_box(box["l"], box["t"], box["r"], box["b"], box["coord_origin"], F.col("h"))),
        order_hint=F.coalesce(F.get("prov.charspan", F.lit(0)), "it.k"),
        cells=F.col("it.cells"),
    )


def from_parsed(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Blocks in pixels; scaled where ``sizes`` (document_id, page_number, width, height in points) knows the page."""
    pages = rows.select("document_id", F.posexplode("payload").alias("p", "page"))
    image = F.coalesce("page.input_img_size", "page.image_size", F.array(F.lit(1.0), F.lit(1.0)))
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    pages = pages.withColumns({"page_number": F.coalesce("page.page_index", "p") + 1, "pw": one(image[0]), "ph": one(image[1])})
    if sizes is not None:
        pages = pages.join(sizes.select("document_id", "page_number", F.col("width").alias("sw"), F.col("height").alias("sh")), ["document_id", "page_number"], "left")
    else:
        pages = pages.withColumns({"sw": F.lit(None).cast("double"), "sh": F.lit(None).cast("double")})
    pages = pages.withColumns({"w": F.coalesce("sw", "pw"), "h": F.coalesce("sh", "ph")})
    blocks = pages.select("*", F.posexplode("page.parsing_res_list").alias("i", "b"))
    return _out(
        blocks,
        page_number=F.col("page_number"),
        width=F.col("w"),
        height=F.col("h"),
        position=F.col("i"),
        provider_block_id=F.format_string("ppstructure-%d-%d", "page_number", "i"),
        provider_type=F.coalesce("b.block_label", F.lit("text")),
        text=F.coalesce("b.block_content", F.lit("")),
        bbox=_scaled(_box(F.col("b.block_bbox")), F.col("w") / F.col("pw"), F.col("h") / F.col("ph")),
        confidence=F.col("b.block_score"),
        order_hint=F.col("i"),
        cells=F.col("b.block_cells"),
    )


CONVERTERS = {"mineru": from_middle, "marker": from_rendered, "docling": from_exported, "ppstructure": from_parsed}

RECORDED = "document_id string, device string, pages array<struct<page_number:int,width:double,height:double,rotation:int,blocks:array<struct<provider_block_id:string,provider_type:string,text:string,bbox:array<double>,confidence:double,order_hint:int,attributes:struct<cells:array<array<string>>,caption:string>>>>>, warnings array<string>, errors array<string>"


#: What a name of a parser ends with if its recorded output is meant.
RECORDED_SUFFIX = "+recorded"


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue of ``<root>/<parser>/<document>.json``: ``parser, document_id, path, payload``, one row per recording.

    Folders that Spark wrote, ``<root>/parser=<parser>/document_id=<document>/<any file>``, are read as well. Listing and
    reading go through Spark's file systems, so the root may be wherever Spark reads. Other files are left out, and
    empty ones, which Spark does not list, are missing recordings. Bytes that are no UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("payload"))
    plain, written = r"/([^/=]+)/([^/=]+)\.json$", r"/parser=([^/=]+)/document_id=([^/=]+)/[^/]+$"
    own = F.col("path").rlike(written)
    name = lambda i: F.url_decode(F.when(own, F.regexp_extract("path", written, i)).otherwise(F.regexp_extract("path", plain, i)))
    return files.where(own | F.col("path").rlike(plain)).select(name(1).alias("parser"), name(2).alias("document_id"), "path", "payload")


def recording_health(spark: SparkSession, catalogue: DataFrame) -> DataFrame:
    """Every adapter's recorded form: ``name, available, recordings, detail``."""
    found = catalogue.groupBy("parser").agg(F.count("*").alias("recordings"))
    rows = adapters(spark).join(F.broadcast(found), "parser", "left").withColumn("recordings", F.coalesce("recordings", F.lit(0)))
    detail = F.when(F.col("recordings") == 0, F.concat(F.lit("no recordings for "), "parser")).otherwise("")
    return rows.select(F.concat("parser", F.lit(RECORDED_SUFFIX)).alias("name"), (F.col("recordings") > 0).alias("available"), "recordings", detail.alias("detail"))


def replay(requests: DataFrame, catalogue: DataFrame, root: str) -> DataFrame:
    """One row per request (``parser`` as ``name+recorded``, ``document_id``): ``pages`` of the recording, or ``error``.

    An unknown parser, a missing recording, one that is malformed and one of another document are rows with an error. Of
    two recordings of one document, the one whose path sorts first counts.
    """
    from ..operators.routing import CAPABILITIES
    from ..operators.schemas import error_record

    asked = requests.select("parser", F.col("document_id").cast("string").alias("document_id"))
    asked = asked.withColumn("_name", F.regexp_replace("parser", r"\+recorded$", ""))
    one = catalogue.groupBy(F.col("parser").alias("_name"), "document_id").agg(F.min_by("payload", "path").alias("payload"), F.min("path").alias("path"))
    rows = asked.join(one, ["_name", "document_id"], "left")
    rows = rows.withColumn("r", F.from_json("payload", f"{RECORDED}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    known = F.col("_name").isin(*CAPABILITIES) & F.col("parser").endswith(RECORDED_SUFFIX)
    code = F.when(~known, "unsupported_input").when(F.col("path").isNull(), "recording_missing").when(F.col("r._corrupt").isNotNull() | F.col("r.document_id").isNull() | (F.col("r.document_id") != F.col("document_id")), "provider_failure")
    message = (
        F.when(~known, F.concat(F.lit("unknown parser "), "parser"))
        .when(F.col("path").isNull(), F.concat(F.lit("no recorded output for "), "_name", F.lit("/"), "document_id"))
        .when(F.col("r._corrupt").isNotNull() | F.col("r.document_id").isNull(), F.concat(F.lit("recorded output for "), "_name", F.lit(" does not match the contract")))
        .otherwise(F.concat(F.lit("recording is for "), "r.document_id", F.lit(", requested "), "document_id"))
    )
    details = F.when(code == "recording_missing", F.create_map(F.lit("expected_path"), F.concat(F.lit(root.rstrip("/") + "/"), "_name", F.lit("/"), "document_id", F.lit(".json"))))
    ok = code.isNull()
    return rows.select("parser", "document_id", *(F.when(ok, F.col(f"r.{c}")).alias(c) for c in ("device", "pages", "warnings", "errors")), F.when(ok, F.col("path")).alias("recording_path"), error_record(code, message, F.col("parser"), details=details).alias("error"))


def recorded_blocks(replayed: DataFrame) -> DataFrame:
    """Provider blocks of the requests that were answered."""
    pages = replayed.where("error is null").select("document_id", F.explode("pages").alias("page"))
    blocks = pages.select("document_id", "page", F.posexplode("page.blocks").alias("position", "b"))
    return blocks.select("document_id", *(F.col(f"page.{c}") for c in ("page_number", "width", "height", "rotation")), "position", *(F.col(f"b.{c}") for c in ("provider_block_id", "provider_type", "text", "bbox", "confidence", "order_hint")), F.col("b.attributes.cells").alias("cells"), F.col("b.attributes.caption").alias("caption"))


def adapters(spark: SparkSession) -> DataFrame:
    """Names of all adapters in order, and which dialect reads their output."""
    from ..operators.routing import CAPABILITIES

    return spark.createDataFrame([(n, n in CONVERTERS) for n in CAPABILITIES], "parser string, readable boolean")


def span_lines(lines: Column) -> Column:
    """Text of ``array<struct<spans: array<struct<text>>>>``: spans joined, lines by line ends."""
    return F.array_join(F.transform(lines, lambda x: F.array_join(F.transform(x["spans"], lambda s: s["text"]), "")), "\n")
