"""Queue transitions on snapshots, and the same over streams.

Locks have no batch form: a claim is a choice among due rows, a lease a
timestamp; "now" is always a parameter.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.shared import written

#: Rows that a limit may gather in one task.
HELD = 100_000
# The step that follows each step.
STEPS = ["VALIDATE", "SPLIT", "NORMALIZE", "CONVERT", "METADATA_EXTRACT", "REDACT", "TRANSLATE", "CHUNK", "EMBED", "KG_EXTRACT"]


def next_step(step: Column, with_graph: Column) -> Column:
    """The step after ``step``; null at the end, and after EMBED unless the graph is wanted."""
    out = F.when((step == "EMBED") & ~with_graph, None)
    for a, b in zip(STEPS, STEPS[1:], strict=False):
        out = out.when(step == a, b)
    return out


def claim(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The ``n`` due jobs of highest priority, oldest first. jobs: job_id, status, priority, created_at, locked_until."""
    due = F.col("status").isin("PENDING", "RETRYING") & (F.col("locked_until").isNull() | (F.col("locked_until") < now))
    return jobs.where(due).orderBy(F.desc("priority"), "created_at", "job_id").limit(n).withColumns({"status": F.lit("PROCESSING"), "locked_until": now + F.expr("INTERVAL 30 MINUTES")})


def reclaim(jobs: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Expired leases go back to RETRYING, or to DEAD_LETTER after ``most`` attempts."""
    lost = (F.col("status") == "PROCESSING") & (F.col("locked_until") < now)
    return jobs.withColumn("status", F.when(lost & (F.col("attempt") >= most), "DEAD_LETTER").when(lost, "RETRYING").otherwise(F.col("status")))


def backoff(attempt: Column) -> Column:
    """Seconds until the next try."""
    return 5 * F.pow(F.lit(2), attempt).cast("int")


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], sticky: list[str]) -> DataFrame:
    """Keyed merge: the new row's values, but ``sticky`` columns keep what is there."""
    rest = [c for c in old.columns if c not in keys]
    j = old.withColumn("__o", F.lit(True)).alias("o").join(new.withColumn("__n", F.lit(True)).alias("n"), keys, "full")
    return j.select(*keys, *(F.when(F.col("__n") & ~(F.coalesce("__o", F.lit(False)) & F.lit(c in sticky)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest))


def retained(rows: DataFrame, now: Column, days: dict[str, int], protected: list[str]) -> DataFrame:
    """Rows that stay; kind decides the age, protected kinds always stay. rows: kind, created_at."""
    limit = F.create_map(*(x for k, v in days.items() for x in (F.lit(k), F.lit(v))))
    age = F.datediff(now, "created_at")
    return rows.where(F.col("kind").isin(protected) | F.try_element_at(limit, F.col("kind")).isNull() | (age <= F.try_element_at(limit, F.col("kind"))))


def once(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Replays of a key within the delay drop out; works on batches and streams."""
    return timed(stream, at).withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.groupBy(key).agg(F.min_by(F.struct(*stream.columns), at).alias("r")).select("r.*")


def timed(stream: DataFrame, at: str) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def windows(stream: DataFrame, at: str, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts by event type and window with late rows up to ``delay``."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return timed(stream, at).withWatermark(at, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(stream: DataFrame, at: str, delay: str, gap: str) -> DataFrame:
    return timed(stream, at).withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def retried(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Failed jobs wait longer each time, and after ``most`` attempts are dead. jobs: status, attempt."""
    failed = F.col("status") == "FAILED"
    dead = failed & (F.col("attempt") + 1 >= most)
    return jobs.withColumns({"status": F.when(dead, "DEAD_LETTER").when(failed, "RETRYING").otherwise(F.col("status")), "wait": F.when(failed & ~dead, backoff(F.col("attempt")))})


def queued(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of queue rows: the greater priority stays, metadata is merged, failed or forced rows wait again.

    old, new: case_id, source, priority, status, note; new also forced.
    """
    j = old.alias("o").join(new.alias("n"), ["case_id", "source"], "full")
    again = F.col("o.status").isNull() | F.col("o.status").isin("failed", "dead") | F.coalesce("n.forced", F.lit(False))
    status = F.when(F.col("n.status").isNull(), F.col("o.status")).when(again, "pending").otherwise(F.col("o.status"))
    return j.select("case_id", "source", F.greatest("o.priority", "n.priority").alias("priority"), status.alias("status"), F.coalesce("n.note", "o.note").alias("note"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of each parent that comes anew are exchanged as a whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def transition(rows: DataFrame, allowed: dict[str, list[str]], wanted: str) -> DataFrame:
    """``status`` moves to the wanted one where that is allowed; ``error`` says why not. rows: status, wanted."""
    table = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    ok = F.coalesce(F.array_contains(F.try_element_at(table, F.col("status")), F.col(wanted)), F.lit(False))
    return rows.withColumns({"error": F.when(~ok, F.concat(F.col("status"), F.lit(" cannot become "), F.col(wanted))), "status": F.when(ok, F.col(wanted)).otherwise(F.col("status"))})


def guarded(rows: DataFrame, guards: list[tuple[str, Column]]) -> Column:
    """Name of the first guard that fails, null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in guards))


def reprocessed(docs: DataFrame, jobs: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(jobs after open ones of the chosen documents are cancelled, new VALIDATE jobs) for at most ``most`` documents by id.

    docs: document_id; jobs: job_id, document_id, step, status.
    """
    chosen = docs.select("document_id").distinct().orderBy("document_id").limit(most)
    hit = jobs.join(chosen.withColumn("__hit", F.lit(True)), "document_id", "left")
    open_ = F.col("status").isin("PENDING", "RETRYING", "PROCESSING") & F.col("__hit").isNotNull()
    after = hit.withColumn("status", F.when(open_, "CANCELLED").otherwise(F.col("status"))).drop("__hit")
    return after, chosen.select("document_id", F.lit("VALIDATE").alias("step"), F.lit("PENDING").alias("status"))


def acquired(queue: DataFrame, paused: DataFrame, now: Column, n: int) -> DataFrame:
    """Due rows of sources that aren't paused. queue: id, source, status, priority, due_at; paused: source."""
    due = queue.where(F.col("status").isin("pending", "retry") & (F.col("due_at") <= now)).join(paused.select("source").distinct(), "source", "left_anti")
    return first_rows(due, [F.desc("priority"), F.col("due_at"), F.col("id")], n)


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order.  A limit gathers its rows in one task: beyond HELD rows the parts of the sort are counted and cut."""
    if n <= HELD:
        return rows.orderBy(*order).limit(n)
    if rows.count() <= n:
        return rows.orderBy(*order)
    # the upper bits of the id are the part of the sort, the lower ones the place in it
    placed = written(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a part
    starts = zip((k for k, _ in sizes), accumulate((c for _, c in sizes), initial=0), strict=False)
    start = F.create_map(*(F.lit(x).cast("bigint") for pair in starts for x in pair))[part]
    return placed.where(start + place < n).orderBy("__id").drop("__id")


def seeded(targets: DataFrame, queue: DataFrame, plan: list[tuple[str, int]]) -> DataFrame:
    """A row for each source of the plan and each target that is not queued. targets: case_id; queue: case_id."""
    new = targets.select("case_id").join(queue.select("case_id").distinct(), "case_id", "left_anti")
    steps = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(p).alias("priority"), F.lit(k + 1).alias("place")) for k, (s, p) in enumerate(plan)))
    return new.select("case_id", F.explode(steps).alias("s")).select("case_id", "s.*")


def stored(artifacts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new documents, a VALIDATE job for each) of artifacts whose content is not known. Both have sha."""
    new = artifacts.join(known.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.min("artifact_id").alias("artifact_id"))
    return new, new.select("artifact_id", F.lit("VALIDATE").alias("step"), F.lit("PENDING").alias("status"))


def text_ready(cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A case with a text artifact is ``text_ready`` unless blocked or dead. cases: case_id, status; artifacts: case_id, kind."""
    has = artifacts.where("kind = 'text'").select("case_id").distinct().withColumn("__has", F.lit(True))
    ready = F.col("__has").isNotNull() & ~F.col("status").isin("blocked", "dead")
    return cases.join(has, "case_id", "left").withColumn("status", F.when(ready, "text_ready").otherwise(F.col("status"))).drop("__has")


def overdue(tasks: DataFrame, now: Column, n: int = 50) -> DataFrame:
    """The oldest open tasks past their due time. tasks: task_id, status, due_at."""
    late = F.col("status").isin("PENDING", "IN_PROGRESS") & (F.col("due_at") < now)
    return tasks.where(late).orderBy("due_at", "task_id").limit(n)


# What becomes of a queue row by the outcome of its attempt, and of a case whose status is final.
DONE_BY, BLOCKED_BY, FINAL = {"hit": "succeeded", "miss": "miss"}, ["captcha_required", "captcha_failed", "blocked_by_policy"], ["text_ready", "blocked", "dead"]


def attempted(queue: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(attempt rows, queue after them) of fetched queue rows.

    queue: id, case_id, source, status, attempt, most, next_at, error; results: id, outcome, error.
    Rate limits wait longer each time until the last attempt fails.
    """
    got = queue.join(results.select("id", "outcome", F.col("error").alias("__said")), "id", "left")
    tried, n = F.col("outcome").isNotNull(), F.col("attempt") + 1
    known = F.create_map(*(F.lit(x) for pair in DONE_BY.items() for x in pair))
    status = F.coalesce(F.try_element_at(known, F.col("outcome")), F.when(F.col("outcome").isin(BLOCKED_BY), "blocked").when(n < F.col("most"), "rate_limited").otherwise("failed"))
    waits = now + F.make_dt_interval(secs=backoff(n))
    got = got.withColumn("__next", F.when(tried & (status == "rate_limited"), waits).when(~tried, F.col("next_at")))
    after = got.withColumns({"status": F.when(tried, status).otherwise(F.col("status")), "attempt": F.when(tried, n).otherwise(F.col("attempt")), "error": F.when(tried, F.col("__said")).otherwise(F.col("error"))})
    after = after.withColumn("next_at", F.col("__next"))
    rows = got.where(tried).select("id", "case_id", "source", "outcome", F.when(F.col("outcome") == "captcha_required", "required").alias("captcha"), F.col("__said").alias("notes"))
    return rows, after.select(queue.columns)


def after_attempts(cases: DataFrame, attempts: DataFrame) -> DataFrame:
    """``cases`` (case_id, status) after attempts (case_id, source, outcome, at): the last that says something counts; final states stay."""
    from casewright.functions.classify import case_status

    silent = (F.col("outcome") == "http_error") | ((F.col("outcome") == "blocked_by_policy") & (F.col("source") != "ecourts"))
    told = attempts.where(~silent).groupBy("case_id").agg(F.max_by(case_status(F.col("source"), F.col("outcome")), "at").alias("__new"))
    return cases.join(told, "case_id", "left").withColumn("status", F.when(F.col("status").isin(FINAL) | F.col("__new").isNull(), F.col("status")).otherwise(F.col("__new"))).drop("__new")


def dead_letters(known: DataFrame, failed: DataFrame) -> DataFrame:
    """Keyed upsert of failures (external_id, source, error, failed_at): a repeat keeps its row, counts a retry and takes the newest error.

    known has retry_count as well.
    """
    last = failed.groupBy("external_id", "source").agg(F.max_by("error", "failed_at").alias("e"), F.max("failed_at").alias("at"), F.count("*").alias("n"))
    j = known.join(last, ["external_id", "source"], "full")
    again = F.col("e").isNotNull()
    count = F.when(F.col("retry_count").isNull(), F.col("n") - 1).otherwise(F.col("retry_count") + F.coalesce("n", F.lit(0)))
    return j.select("external_id", "source", F.when(again, F.col("e")).otherwise(F.col("error")).alias("error"), F.when(again, F.col("at")).otherwise(F.col("failed_at")).alias("failed_at"), count.cast("bigint").alias("retry_count"))


# Kinds of batch jobs with the numbers that they take and what these are by default.
BATCH = {"seed": {"limit": 1000}, "discover": {"start": 1, "count": 100}, "process": {"limit": 100}}


def dispatched(jobs: DataFrame) -> DataFrame:
    """``jobs`` (job_type, params as JSON) with ``arguments``, a map of the numbers of their kind, and ``error`` for unknown kinds."""
    arguments = F.lit(None).cast("map<string,int>")
    for kind, names in BATCH.items():
        given = [x for name, usual in names.items() for x in (F.lit(name), F.coalesce(F.nullif(F.get_json_object("params", f"$.{name}").try_cast("int"), F.lit(0)), F.lit(usual)))]
        arguments = F.when(F.col("job_type") == kind, F.create_map(*given)).otherwise(arguments)
    known = F.coalesce(F.col("job_type").isin(*BATCH), F.lit(False))
    return jobs.withColumns({"arguments": arguments, "error": F.when(~known, F.concat(F.lit("unsupported job type: "), F.coalesce("job_type", F.lit(""))))})
