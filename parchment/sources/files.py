"""Manifests, truth files, originals and report sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import MAX_UPLOAD_BYTES
from ..operators.schemas import MANIFEST, TRUTH


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_number, line``: all lines of text files, counted from 1 in each file, however Spark splits it.

    Lines are ranked within their split, and the lines of the splits before it are added; a file has few splits.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    split = Window.partitionBy("path", "block")
    ranked = rows.withColumn("rank", F.row_number().over(split.orderBy("seq")))
    sizes = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("path", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return ranked.join(before, ["path", "block"]).select("path", (F.col("before") + F.col("rank")).alias("line_number"), "line")


#: Values that an entry may have (fixed values).
LABELS = {
    "route_label": ("born_digital", "scanned", "mixed", "garbled_text_layer", "encrypted", "unsupported"),
}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines without blank ones and comments: the entry, ``line_number``, and what is wrong with it.

    ``problem`` is ``malformed`` (no JSON, or of other types), ``unknown_keys``, ``missing_keys``, ``unknown_label``,
    ``duplicate_id`` (of a row after the first with its id) or ``no_entries`` (the only row of a file without entries).
    """
    known = [c.split()[0] for c in MANIFEST.split(", ")]
    needed = ("document_id", "path", "route_label", "difficulty", "provenance")
    every = numbered_lines(spark, path).withColumn("line", F.trim("line"))
    lines = every.where("line <> '' and not startswith(line, '#')")
    rows = lines.select("path", "line_number", F.from_json("line", MANIFEST + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m"), F.json_object_keys("line").alias("keys"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("path", "m.document_id").orderBy("line_number")))
    unknown = F.array_except("keys", F.array(*map(F.lit, known)))
    missing = F.filter(F.array(*(F.when(F.coalesce(F.col(f"m.{c}"), F.lit("")) == "", F.lit(c)) for c in needed)), lambda c: c.isNotNull())
    problem = (
        F.when(F.col("m").isNull() | F.col("m._bad").isNotNull() | F.col("keys").isNull(), "malformed").when(F.size(unknown) > 0, "unknown_keys").when(F.size(missing) > 0, "missing_keys")
        .when(~F.col("m.route_label").isin(*LABELS["route_label"]), "unknown_label").when(F.col("_nth") > 1, "duplicate_id")
    )
    detail = F.when(problem == "unknown_keys", F.array_join(unknown, ",")).when(problem == "missing_keys", F.array_join(missing, ",")).when(problem == "unknown_label", F.col("m.route_label")).when(problem == "duplicate_id", F.col("m.document_id"))
    entries = rows.select(*(F.col(f"m.{c}") for c in known), "line_number", problem.alias("problem"), detail.alias("problem_detail"))
    none = every.agg(F.count_if((F.col("line") != "") & ~F.col("line").startswith("#")).alias("n")).where("n = 0")
    empty = none.select(*(F.lit(None).cast("string").alias(c) for c in known), F.lit(None).cast("long").alias("line_number"), F.lit("no_entries").alias("problem"), F.lit(None).cast("string").alias("problem_detail"))
    return entries.unionByName(empty)


def resolved(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` steps; a step above the root stays at the root."""
    up = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), up), "/"))


def private_path_error(path: Column, root: str) -> Column:
    """Why a private document may not stand at ``path``: it must be absolute and lead out of ``root``; null if it may.

    Links are not followed, as paths may be of any file system.
    """
    own = resolved(F.lit(root))
    inside = (resolved(path) == own) | resolved(path).startswith(F.concat(F.when(own == "/", "").otherwise(own), F.lit("/")))
    return F.when(~path.startswith("/"), "private_path_relative").when(inside, "private_path_inside")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file: ``path`` and the columns of ``TRUTH``, all null where the file is no truth.

    Files that do not parse, have other types, unknown keys or no document id are none.
    """
    known = F.array(*(F.lit(c.split()[0]) for c in re.split(r", (?=[a-z_]+ )", TRUTH)))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"{TRUTH}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("t"), F.json_object_keys("value").alias("keys"))
    good = F.col("t._bad").isNull() & (F.coalesce(F.col("t.document_id"), F.lit("")) != "") & (F.size(F.array_except("keys", known)) == 0)
    truth = F.when(good, F.col("t").dropFields("_bad"))
    return rows.select("path", truth.alias("t")).select("path", "t.*")


def audit_manifest(manifest: DataFrame, files: DataFrame, truth: DataFrame | None = None, root: str = "/") -> DataFrame:
    """``document_id, problem, detail``: files and truth files that are missing, truth that is invalid or of another document,
    and private entries whose paths are not out of ``root``.

    ``files``: the paths that there are. ``truth``: ``path`` and ``document_id`` of each truth file, null where it does not
    parse.
    """
    known = files.select(F.col("path").alias("_p")).distinct()
    missing = manifest.join(known, manifest["path"] == known["_p"], "left_anti").select("document_id", F.lit("missing_file").alias("problem"), F.col("path").alias("detail"))
    labelled = manifest.where("ground_truth is not null")
    lost = labelled.join(known, labelled["ground_truth"] == known["_p"], "left_anti").select("document_id", F.lit("missing_truth").alias("problem"), F.col("ground_truth").alias("detail"))
    private = manifest.where("provenance = 'private'").select("document_id", F.explode(F.array("path", "ground_truth")).alias("detail")).where("detail is not null")
    private = private.withColumn("problem", private_path_error(F.col("detail"), root)).where("problem is not null").select("document_id", "problem", "detail")
    out = missing.unionByName(lost).unionByName(private)
    if truth is not None:
        own = truth.select(F.col("path").alias("_t"), F.col("document_id").alias("truth_id"))
        met = labelled.join(own, labelled["ground_truth"] == own["_t"]).where("truth_id is null or document_id <> truth_id")
        problem = F.when(F.col("truth_id").isNull(), "invalid_truth").otherwise("truth_of_another")
        out = out.unionByName(met.select("document_id", problem.alias("problem"), F.coalesce("truth_id", "ground_truth").alias("detail")))
    return out


def read_originals(spark: SparkSession, path: str, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Files up to ``limit`` bytes; larger ones are left unread (the size filter reaches the file listing)."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit)
    return rows.select("path", F.col("length").alias("byte_size"), F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("head"), F.sha2("content", 256).alias("checksum_sha256"))
