"""Job queue semantics on tables: transitions, enqueueing, leases, claims and failures.

A batch (or micro-batch) is the only writer, which stands in for row locks and compare-and-set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from .schemas import RETRYABLE, error_record
from .staging import staged

#: Allowed moves (fixed values).
DOCUMENT_MOVES = {
    "UPLOADED": ("INSPECTING", "QUEUED_FOR_PARSE", "UNSUPPORTED"),
    "INSPECTING": ("QUEUED_FOR_PARSE", "PARSING", "UNSUPPORTED", "PARSE_FAILED"),
    "QUEUED_FOR_PARSE": ("INSPECTING", "PARSING", "PARSE_FAILED"),
    "PARSING": ("NORMALIZING", "QUEUED_FOR_PARSE", "PARSE_FAILED", "UNSUPPORTED"),
    "NORMALIZING": ("STRUCTURING", "PARSE_FAILED"),
    "STRUCTURING": ("READY_FOR_REVIEW", "PARSE_FAILED"),
    "READY_FOR_REVIEW": ("QUEUED_FOR_PARSE", "INDEXING", "READY"),
    "INDEXING": ("READY", "PARSE_FAILED"),
    "READY": ("QUEUED_FOR_PARSE",),
    "PARSE_FAILED": ("QUEUED_FOR_PARSE",),
    "UNSUPPORTED": (),
}
JOB_MOVES = {
    "QUEUED": ("LEASED",),
    "LEASED": ("RUNNING", "QUEUED"),
    "RUNNING": ("SUCCEEDED", "FAILED_RETRYABLE", "FAILED_TERMINAL", "QUEUED"),
    "FAILED_RETRYABLE": ("QUEUED", "FAILED_TERMINAL"),
    "SUCCEEDED": (),
    "FAILED_TERMINAL": (),
}
TERMINAL_JOBS = ("SUCCEEDED", "FAILED_TERMINAL")
TERMINAL_CODES = ("encrypted_pdf", "invalid_pdf", "unsupported_input", "normalization_failure", "parser_strategy_undecided")
UNSUPPORTED_CODES = ("encrypted_pdf", "invalid_pdf")


def move_allowed(current: Column, target: Column, moves: dict[str, tuple[str, ...]], same: bool) -> Column:
    """Whether a move is allowed; to stay is, for documents only."""
    table = F.create_map(*(x for k, t in moves.items() for x in (F.lit(k), F.array(*map(F.lit, t)) if t else F.array().cast("array<string>"))))
    allowed = F.coalesce(F.array_contains(table[current], target), F.lit(False))
    return allowed | (current == target) if same else allowed


def illegal_moves(history: DataFrame, moves: dict[str, tuple[str, ...]], key: str, *order: str, same: bool = True) -> DataFrame:
    """Rows of a status history that cannot follow the row before; one window by key."""
    rows = history.withColumn("previous", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))
    return rows.where(F.col("previous").isNotNull() & ~move_allowed(F.col("previous"), F.col("status"), moves, same))


def enqueue(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per requested document and target version, the job that serves it: a live job is reused, else a new key is made.

    ``requests``: document_id, next_version. ``jobs``: document_id, idempotency_key, status. The key's generation is the
    number of the first key of the version that no job holds or that a live job holds.
    """
    base = F.concat(F.col("document_id"), F.lit(":parse:v"), F.col("next_version"))
    wanted = requests.select("document_id", "next_version").distinct().withColumn("base_key", base)
    own = jobs.withColumns({"_base": F.substring_index("idempotency_key", "#", 1), "generation": F.coalesce(F.regexp_extract("idempotency_key", r"#(\d+)$", 1).try_cast("int"), F.lit(0))})
    held = own.groupBy("_base").agg(
        F.min(F.when(~F.col("status").isin(*TERMINAL_JOBS), F.col("generation"))).alias("live"),
        F.array_sort(F.collect_set("generation")).alias("taken"),
    )
    rows = wanted.join(held, wanted["base_key"] == held["_base"], "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.coalesce(F.size("taken"), F.lit(0))), F.coalesce("taken", F.array().cast("array<int>"))))
    generation = F.coalesce(F.when(F.col("live") < free, F.col("live")), free)
    key = F.when(generation == 0, F.col("base_key")).otherwise(F.concat_ws("#", "base_key", generation.cast("string")))
    return rows.select("document_id", key.alias("idempotency_key"), (F.coalesce(F.col("live") < free, F.lit(False))).alias("reused"))


def release_expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after the sweep: leased and running ones without a living lease are queued again, at once.

    Adds ``released`` and ``document_status``, the status that the document of a released job falls back to.
    """
    expired = F.col("status").isin("LEASED", "RUNNING") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    return jobs.withColumns(
        {
            "released": expired,
            "status": F.when(expired, "QUEUED").otherwise(F.col("status")),
            "leased_by": F.when(~expired, F.col("leased_by")),
            "lease_expires_at": F.when(~expired, F.col("lease_expires_at")),
            "available_at": F.when(expired, now).otherwise(F.col("available_at")),
            "document_status": F.when(expired, "QUEUED_FOR_PARSE"),
        }
    )


def runnable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "QUEUED") & (F.col("available_at").isNull() | (F.col("available_at") <= now)))


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    """The oldest runnable job: at most one row."""
    return runnable(jobs, now).orderBy("created_at", "id").limit(1)


def claim(jobs: DataFrame, workers: list[str], now: Column, lease_seconds: int = v.LEASE_SECONDS) -> DataFrame:
    """The oldest runnable jobs, one for each worker, as leased rows: a top-k, then a rank over these few."""
    oldest = runnable(jobs, now).orderBy("created_at", "id").limit(max(len(workers), 1))
    rank = F.row_number().over(Window.orderBy("created_at", "id"))  # over at most as many rows as workers
    names = F.array(*map(F.lit, workers))
    rows = oldest.withColumn("leased_by", F.get(names, rank - 1)).where("leased_by is not null")
    return rows.withColumns({"status": F.lit("LEASED"), "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds))})


def lease_next(jobs: DataFrame, workers: list[str], now: Column, lease_seconds: int = v.LEASE_SECONDS) -> DataFrame:
    """Sweep, then claim."""
    return claim(release_expired(jobs, now), workers, now, lease_seconds)


def _own_or(rows: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in rows.columns else default


def after_failure(rows: DataFrame, now: Column, max_attempts: int = v.MAX_ATTEMPTS, backoff: int = v.BACKOFF_SECONDS) -> DataFrame:
    """Running jobs with an ``error_code``: next status, attempt, availability, and the document's status.

    A job's own ``max_attempts`` and an error's own ``retryable``, where there are such columns, go before the defaults.
    The lease ends with the run. A job that ends for good keeps its availability.
    """
    curable = _own_or(rows, "retryable", F.col("error_code").isin(*RETRYABLE)) & ~F.col("error_code").isin(*TERMINAL_CODES)
    again = curable & (F.col("attempt") + 1 < _own_or(rows, "max_attempts", F.lit(max_attempts)))
    before = F.col("available_at") if "available_at" in rows.columns else F.lit(None).cast("timestamp")
    return rows.withColumns(
        {
            "status": F.when(again, "QUEUED").otherwise("FAILED_TERMINAL"),
            "document_status": F.when(again, "QUEUED_FOR_PARSE").when(F.col("error_code").isin(*UNSUPPORTED_CODES), "UNSUPPORTED").otherwise("PARSE_FAILED"),
            "available_at": F.when(again, now + F.make_dt_interval(secs=F.lit(backoff))).otherwise(before),
            "attempt": F.col("attempt") + 1,
            "leased_by": F.lit(None).cast("string"),
            "lease_expires_at": F.lit(None).cast("timestamp"),
        }
    )


def run_leased(jobs: DataFrame, now: Column, max_attempts: int = v.MAX_ATTEMPTS, backoff: int = v.BACKOFF_SECONDS) -> DataFrame:
    """Leased jobs with the ``error_code`` of their run (null: it succeeded) after that run; a failure is a row like others.

    Adds ``job_walk`` and ``document_walk``, the statuses passed through in order, to what ``after_failure`` gives. A run that
    fails before parsing (``before_parsing``, if there is such a column: the original or the strategy could not be read) never
    gets there. ``job_error`` is the structured error, with ``error_message`` if there is such a column; the document keeps code
    and message in ``document_error_code`` and ``document_error_message``, and a run that succeeds clears both.
    """
    early = _own_or(jobs, "before_parsing", F.lit(False))
    failed = after_failure(jobs.where("error_code is not null"), now, max_attempts, backoff)
    message = _own_or(jobs, "error_message", F.lit(""))
    failed = failed.withColumns({"job_error": error_record(F.col("error_code"), message, retryable=_own_or(jobs, "retryable", F.col("error_code").isin(*RETRYABLE))), "document_error_code": F.col("error_code"), "document_error_message": message})
    again = F.col("status") == "QUEUED"
    failed = failed.withColumns(
        {
            "job_walk": F.when(again, F.array(*map(F.lit, ("RUNNING", "FAILED_RETRYABLE", "QUEUED")))).otherwise(F.array(*map(F.lit, ("RUNNING", "FAILED_TERMINAL")))),
            "document_walk": F.when(early, F.array(F.lit("INSPECTING"), F.col("document_status"))).otherwise(F.array(F.lit("INSPECTING"), F.lit("PARSING"), F.col("document_status"))),
        }
    )
    done = jobs.where("error_code is null").withColumns(
        {
            "status": F.lit("SUCCEEDED"),
            "document_status": F.lit("READY_FOR_REVIEW"),
            "attempt": F.col("attempt") + 1,
            "leased_by": F.lit(None).cast("string"),
            "lease_expires_at": F.lit(None).cast("timestamp"),
            "job_walk": F.array(F.lit("RUNNING"), F.lit("SUCCEEDED")),
            "document_walk": F.array(*map(F.lit, ("INSPECTING", "PARSING", "NORMALIZING", "STRUCTURING", "READY_FOR_REVIEW"))),
        }
    )
    return done.unionByName(failed, allowMissingColumns=True)


#: Jobs that one pass takes at most.
MAX_JOBS = 100


def drain_pass(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], now: Column, worker: str = "worker", max_jobs: int = MAX_JOBS, lease_seconds: int = v.LEASE_SECONDS) -> DataFrame:
    """All jobs after one pass: leases that ended are swept, then the oldest runnable jobs, ``max_jobs`` at most, are run.

    ``run`` adds ``error_code`` (null: it succeeded) to leased jobs. As a failed job waits for its backoff, no job runs twice
    in a pass. The taken jobs are a top-k, so no more than ``max_jobs`` rows meet in a task. ``ran`` tells them.
    """
    if max_jobs < 1:
        raise ValueError("a pass takes at least one job")
    swept = release_expired(jobs, now).drop("released", "document_status")
    taken = runnable(swept, now).orderBy("created_at", "id").limit(max_jobs)
    leased = taken.withColumns({"status": F.lit("LEASED"), "leased_by": F.lit(worker), "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds))})
    done = staged(run_leased(run(staged(leased, "leased")), now), "done")
    rest = swept.join(F.broadcast(done.select("id")), "id", "left_anti").withColumn("ran", F.lit(False))  # max_jobs ids
    return rest.unionByName(done.withColumn("ran", F.lit(True)), allowMissingColumns=True)


def reprocess_error(status: Column) -> Column:
    """Why a document cannot be parsed again; null if it can."""
    return F.when(status == "UNSUPPORTED", "document_unsupported").when(status.isin("UPLOADED", "INSPECTING", "QUEUED_FOR_PARSE", "PARSING", "NORMALIZING", "STRUCTURING", "INDEXING"), "document_processing")
