"""Runs of parsers over documents as rows: each run is isolated inside its task, so a failure is a result like others.

A run that raises, one that takes too long and one of an unknown parser give rows with a structured error; the other runs of
the task go on. Python's own limits hold: a parser that blocks outside the interpreter cannot be stopped by the timer.

A null payload is handed to the parser as null. Repeated rows are runs of their own. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import json
import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

from .schemas import RETRYABLE

RUN_FRAME = (
    "parser string, document_id string, status string, error struct<code:string,message:string,retryable:boolean,parser_name:string,details:map<string,string>>, "
    "seconds double, result string"
)


class ParserFailure(Exception):
    """A failure that a parser names itself."""

    def __init__(self, code: str, message: str, retryable: bool | None = None, details: dict[str, str] | None = None):
        super().__init__(message)
        self.code, self.retryable, self.details = code, code in RETRYABLE if retryable is None else retryable, details or {}


class _TooSlow(BaseException):
    """Not an Exception, so that a parser that catches those does not catch it."""


@contextmanager
def _limited(seconds: float | None) -> Iterator[None]:
    if seconds is None:
        yield
        return

    def stop(*_):
        raise _TooSlow

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _run(parse: Callable | None, name: str, payload: str | None, limit: float | None) -> tuple:
    """Status, error, seconds and result of one run."""
    began = time.monotonic()

    def failed(code: str, message: str, retryable: bool, details: dict[str, str]) -> tuple:
        return "failed", {"code": code, "message": message, "retryable": retryable, "parser_name": name, "details": list(details.items())}, time.monotonic() - began, None

    if parse is None:
        return failed("unsupported_input", f"unknown parser {name}", False, {})
    try:
        with _limited(limit):
            result = parse(payload)
        return "ok", None, time.monotonic() - began, json.dumps(result, ensure_ascii=False, sort_keys=True)
    except ParserFailure as e:
        return failed(e.code, str(e), e.retryable, e.details)
    except _TooSlow:
        return failed("parse_timeout", f"stopped after {limit:g} s", True, {})
    except Exception as e:  # noqa: BLE001 - a parser that crashes is a result
        return failed("provider_failure", f"{type(e).__name__}: {e}", False, {})


def run_frame(pairs: DataFrame, parsers: dict[str, Callable[[str | None], object]], limit_seconds: float | None = None) -> DataFrame:
    """One row per row of ``pairs`` (``parser, document_id, payload``): status, error, seconds, and the result as JSON.

    ``parsers`` are functions of the payload; what they return must fit into JSON. Results of several megabytes are
    handed on row by row.
    """
    at_once = 64
    kinds = pa.schema(
        [
            ("parser", pa.string()), ("document_id", pa.string()), ("status", pa.string()),
            ("error", pa.struct([("code", pa.string()), ("message", pa.string()), ("retryable", pa.bool_()), ("parser_name", pa.string()), ("details", pa.map_(pa.string(), pa.string()))])),
            ("seconds", pa.float64()), ("result", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("parser", "document_id", "payload")), strict=True)
            done = ((name, document, *_run(parsers.get(name), name, payload, limit_seconds)) for name, document, payload in rows)
            while some := [row for _, row in zip(range(at_once), done, strict=False)]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    return pairs.select("parser", pairs["document_id"].cast("string").alias("document_id"), "payload").mapInArrow(run, RUN_FRAME)
