"""A work queue as an append-only table of events: job_id, seq, at, and whatever an event sets (state, stage, ...).

A job's present fields are the last values that its events set, so patches, claims and stale jobs are aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUEUED, RUNNING, NEEDS_HEADER, PARSED, FAILED, REJECTED = "QUEUED", "RUNNING", "NEEDS_HEADER", "PARSED", "FAILED", "REJECTED"
# The moves between states, seconds after which a claim is stale, and the least length of a reason.
MOVES = {(None, QUEUED), (None, REJECTED), (QUEUED, RUNNING), (RUNNING, QUEUED), (RUNNING, NEEDS_HEADER), (RUNNING, PARSED), (RUNNING, FAILED), (NEEDS_HEADER, QUEUED), (REJECTED, QUEUED)}
STALE_SECONDS, REASON = 3600, 8
ROLES = ("ARTICLE_CLERK", "SENIOR_ACCOUNTANT", "PARTNER")


def latest(events: DataFrame) -> DataFrame:
    """Each job's present fields: the last that was set of each; created_at, updated_at and n_events."""
    fields = [c for c in events.columns if c not in ("job_id", "seq", "at")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    return events.groupBy("job_id").agg(F.min("at").alias("created_at"), F.max_by("at", "seq").alias("updated_at"), F.count("*").alias("n_events"), *last)


def illegal_moves(events: DataFrame) -> DataFrame:
    """State changes that the machine doesn't know: job_id, seq, before, state."""
    w = Window.partitionBy("job_id").orderBy("seq")
    moved = events.filter("state IS NOT NULL").withColumn("before", F.lag("state").over(w))
    legal = F.lit(False)
    for a, b in sorted(MOVES, key=str):
        legal = legal | (F.col("before").eqNullSafe(F.lit(a)) & (F.col("state") == b))
    return moved.filter(~legal).select("job_id", "seq", "before", "state")


def queue(jobs: DataFrame, state: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first."""
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    rows = jobs if state is None else jobs.filter(F.col("state") == state)
    return rows.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(limit)


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The oldest queued jobs."""
    return jobs.filter(F.col("state") == QUEUED).orderBy("created_at", "job_id").limit(n)


def claim_events(jobs: DataFrame, worker: str, at: Column, n: int = 1) -> DataFrame:
    """The events that hand the oldest queued jobs to a worker."""
    return claim(jobs, n).select("job_id", (F.col("n_events") + 1).alias("seq"), at.alias("at"), F.lit(RUNNING).alias("state"), F.lit(worker).alias("claimed_by"))


def stale(events: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Running jobs that nothing has been heard of (progress counts) for that long."""
    return latest(events).filter((F.col("state") == RUNNING) & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds))))


def requeue_events(events: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    return stale(events, now, seconds).select("job_id", (F.col("n_events") + 1).alias("seq"), now.alias("at"), F.lit(QUEUED).alias("state"))


def counts_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def rows_page(rows: DataFrame, job_id, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of a job's stored rows, by index."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    return rows.filter(F.col("job_id") == F.lit(job_id)).orderBy("idx").offset(offset).limit(limit)


def audit_of_job(entries: DataFrame, job_id) -> DataFrame:
    return entries.filter(F.col("job_id") == F.lit(job_id)).orderBy("id")


def audit_recent(entries: DataFrame, limit: int = 100) -> DataFrame:
    return entries.orderBy(F.desc("id")).limit(limit)


def allowed(entries: DataFrame, needed: str, role: str = "role") -> DataFrame:
    """Entries by principals of at least this role."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role))
    return entries.filter(rank > ROLES.index(needed))


def override_events(jobs: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Events of valid override requests (job_id, role, reason): partners only, with a reason, of rejected jobs."""
    valid = allowed(requests, "PARTNER").filter(F.length(F.trim("reason")) >= REASON)
    rejected = jobs.filter(F.col("state") == REJECTED).select("job_id", "n_events")
    return valid.join(rejected, "job_id").select("job_id", (F.col("n_events") + 1).alias("seq"), at.alias("at"), F.lit(QUEUED).alias("state"), F.col("reason"))


def creation_event(uploads: DataFrame, content: str, at: Column) -> DataFrame:
    """The first event of each upload; its id is the digest of its content, so that a repeated run adds the same job."""
    return uploads.select(F.sha2(F.col(content), 256).alias("job_id"), F.lit(1).cast("long").alias("seq"), at.alias("at"), F.lit(QUEUED).alias("state"), F.lit("HEADER").alias("stage"), *[c for c in uploads.columns if c != content])


def lookup(jobs: DataFrame, job_id) -> DataFrame:
    """One job; no row if there is none."""
    return jobs.filter(F.col("job_id") == F.lit(job_id))


def total(rows: DataFrame, name: str = "total") -> DataFrame:
    """The count beside a page: of all the rows that it is a page of."""
    return rows.agg(F.count("*").alias(name))


def decoded(page: DataFrame, schema: str) -> DataFrame:
    """Stored rows with their payload as columns; money and dates travel as text."""
    return page.withColumn("__p", F.from_json("payload", schema)).select("job_id", "idx", "__p.*")


# Answers to an upload that was taken, is of another kind, or cannot be read.
CREATED, UNSUPPORTED, UNREADABLE = 201, 415, 422


def intake(uploads: DataFrame, graded: DataFrame, at: Column, blocks: bool = True) -> DataFrame:
    """What becomes of uploads (job_id, filename): status, state, stage, message. Only PDF names are taken; files without a
    grade (job_id, verdict, summary) could not be read; rejected captures are not queued if ``blocks``."""
    pdf = F.endswith(F.lower(F.coalesce("filename", F.lit(""))), F.lit(".pdf"))
    seen = uploads.join(graded.select("job_id", "verdict", "summary"), "job_id", "left")
    status = F.when(~pdf, UNSUPPORTED).when(F.col("verdict").isNull(), UNREADABLE).otherwise(CREATED)
    rejected = (F.col("verdict") == "REJECT") & F.lit(blocks)
    taken = F.col("status") == CREATED
    out = seen.withColumn("status", status).withColumn("state", F.when(taken, F.when(rejected, REJECTED).otherwise(QUEUED)))
    message = F.when(taken, F.col("summary")).when(F.col("status") == UNSUPPORTED, "only PDF statements are accepted").otherwise("could not read the PDF")
    return out.select("job_id", "filename", F.lit(1).cast("long").alias("seq"), at.alias("at"), "status", "state", F.when(F.col("state") == QUEUED, "HEADER").alias("stage"), "verdict", message.alias("message"))


def override_entries(jobs: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Audit entries of valid override requests: partners only, with a reason; of any job, whatever its state."""
    valid = allowed(requests, "PARTNER").filter(F.length(F.trim("reason")) >= REASON)
    detail = F.concat(F.lit("state="), F.coalesce("state", F.lit("none")))
    return valid.join(jobs.select("job_id", "state"), "job_id").select("job_id", at.alias("at"), F.lit("OVERRIDE").alias("action"), detail.alias("detail"), "reason")


def with_overridden(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Jobs with whether the audit log holds an override of theirs."""
    named = entries.filter("action = 'OVERRIDE'").select("job_id", F.lit(True).alias("overridden")).distinct()
    return jobs.join(named, "job_id", "left").fillna(False, ["overridden"])


# The fields that a list of jobs shows, and those that one job's page adds.
SUMMARY = (
    "job_id", "filename", "state", "stage", "created_at", "updated_at", "profile_key", "quality_verdict", "account_no", "holder", "page_count",
    "row_count", "unresolved", "reconciled", "opening", "closing", "variance", "progress_done", "progress_total", "error",
)
DETAIL = (*SUMMARY, "quality", "chain", "categories", "blocks_export")


def view(jobs: DataFrame, fields: tuple[str, ...] = SUMMARY) -> DataFrame:
    """The fields of a view, in order; those that nothing has set yet are null."""
    have = set(jobs.columns)
    return jobs.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in fields])
