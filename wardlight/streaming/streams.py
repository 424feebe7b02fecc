"""Structured Streaming forms: classification, latest selection, snapshot refresh, and job health."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlight.operators.spatial import classify


def classify_stream(points: DataFrame, features: DataFrame, cell: float | None = None) -> DataFrame:
    """A stream of points (pid, x, y, …) against static features. Parity is tested within the row, so there is no state."""
    return classify(points, features, cell)


def latest_only(selections: DataFrame, minutes: int | None = None) -> DataFrame:
    """A stream (session, seq, …) → of each batch a session's newest row, if its seq exceeds all before it.

    With `minutes`, sessions idle for so long are forgotten; such a query runs until it is stopped, since its clock does.
    """
    columns = selections.columns

    def newer(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else -1
        newest, best = None, seen
        for part in parts:
            seqs = part["seq"].to_numpy()
            at = seqs.argmax() if seqs.dtype.kind == "i" else part["seq"].fillna(-1).to_numpy().argmax()
            if seqs[at] > best:
                newest, best = part.iloc[[at]], int(seqs[at])
        state.update((best,))
        if minutes is not None:
            state.setTimeoutDuration(minutes * 60_000)
        if newest is not None:
            yield newest[columns]

    return selections.groupBy("session").applyInPandasWithState(
        newer, selections.schema, "seq long", "append",
        GroupStateTimeout.NoTimeout if minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def _marked(spark: SparkSession, commits: str, epoch: int, state: str, write: bool = False) -> bool:
    """Whether an epoch has a mark in the commit table, which is a folder of empty files; write: makes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{commits}/epoch={epoch}/{state}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if write:
        files.create(path, True).close()
    return write or files.exists(path)


def by_epoch(path: str) -> Callable[[DataFrame, int], None]:
    """A publisher that may be repeated: what an epoch wrote before is overwritten."""
    return lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def refresh(
    snapshots: DataFrame, gate: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None],
    hold: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, commits: str | None = None
):
    """Starts a query that judges each arriving batch: gate gives findings; a batch with a FAIL is held with them, others are published.

    commits: a folder in which each epoch is marked before and after it is published or held. An epoch that is marked done
    is not judged again when its batch is repeated, be it that the query failed after publishing or that it starts from a
    lost checkpoint. One that was begun and not finished is repeated, so publish and hold must overwrite what they wrote
    for the epoch (see by_epoch).
    """

    def judge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if commits and _marked(spark, commits, epoch, "done"):
            return
        kept = batch.persist()
        try:
            findings = gate(kept)
            bad = findings.where("severity = 'FAIL'")
            if commits:
                _marked(spark, commits, epoch, "begun", True)
            (publish(kept, epoch) if bad.isEmpty() else hold(findings, epoch))
            if commits:
                _marked(spark, commits, epoch, "done", True)
        finally:
            kept.unpersist()

    writer = snapshots.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


DAY = 86_400_000
PASSING = ("success", "cancelled", "skipped")


def _due(job: dict, latest_at: int | None, ok_at: int | None) -> int | None:
    """When the verdict next changes by time alone, in milliseconds; null if it does not."""
    young_until = None if job["created"] is None else job["created"] + (job["cadence"] + 1) * DAY
    if latest_at is None:
        return young_until
    stale_from = None if ok_at is None else ok_at + (job["cadence"] * 2 + 3) * DAY
    return max((x for x in (young_until, stale_from) if x is not None), default=None)


def _verdict(job: dict, latest: str | None, latest_at: int | None, ok_at: int | None, now: int) -> str:
    """A job's verdict at `now`, as rosters.run_health gives it."""
    young = job["created"] is not None and (now - job["created"]) // DAY <= job["cadence"]
    if job["state"] != "active":
        return "DISABLED"
    if latest_at is None:
        return "NEW" if young else "SILENT"
    if latest not in PASSING:
        return "UNPROVEN" if job["code_at"] is not None and job["code_at"] > latest_at else "FAILING"
    if ok_at is None or (now - ok_at) // DAY > job["cadence"] * 2 + 2:
        return "NEW" if young else "STALE"
    return "OK"


def health_verdicts(runs: DataFrame, jobs: DataFrame, late: str = "1 day", first_by: str | None = None) -> DataFrame:
    """A stream of runs (job, status, conclusion, created_at) and jobs (see rosters.run_health) → job, verdict, at: each change.

    A job's verdict changes with a run, at the run's time, or by time alone (STALE, and SILENT for a new job): then a timer
    on event time tells it, once the watermark has passed, without a new run. Each verdict is what run_health gives at that
    time for the runs up to it. A job is known from its first run on, completed or not. Runs that come after the watermark,
    `late` behind the newest run, are dropped; a run older than the job's latest changes nothing but the last success. Runs of
    one time (in milliseconds) are judged together, and a failed one counts as the latest of them; where `first_by` names an
    integer column of the runs, the completed one with its least value does, as SQL's arg_max keeps the first that it meets.
    State is one row a job; a job's runs within a batch are sorted in its task.
    """
    known = jobs.select(
        "job", F.coalesce("cadence_days", F.lit(7)).cast("long").alias("cadence"), F.coalesce("state", F.lit("active")).alias("state"),
        F.unix_millis("created").alias("created"), F.unix_millis("code_at").alias("code_at")
    )
    rows = runs.withWatermark("created_at", late).join(known, "job").select(
        "job", "status", F.coalesce("conclusion", F.lit("")).alias("conclusion"), "created_at", F.unix_millis("created_at").alias("ms"), "cadence", "state", "created", "code_at",
        (F.lit(None) if first_by is None else F.col(first_by)).cast("long").alias("place")
    )
    whole = lambda v: None if pd.isna(v) else int(v)

    def told(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = latest_at = ok_at = verdict = job = place = None
        if state.exists:
            verdict, latest, latest_at, ok_at, cadence, active, created, code_at, place = state.get
            job = {"cadence": cadence, "state": active, "created": created, "code_at": code_at}
        out = []

        def change(now: int) -> None:
            nonlocal verdict
            new = _verdict(job, latest, latest_at, ok_at, now)
            if new != verdict:
                verdict = new
                out.append((key[0], new, pd.Timestamp(now, unit="ms")))

        def ahead(r) -> bool:
            """Whether a run counts before the latest, which has its time."""
            return (r.fails or latest in PASSING) if first_by is None else not pd.isna(r.place) and (place is None or r.place < place)

        def pass_to(now: int) -> None:
            """The changes that time alone brings before `now`."""
            due = _due(job, latest_at, ok_at)
            if due is not None and due <= now:
                change(due)

        if state.hasTimedOut:
            pass_to(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(parts)).assign(fails=lambda r: ~r["conclusion"].isin(PASSING)).sort_values(["ms", "fails", "conclusion"])
            begin, end = rows["ms"].ne(rows["ms"].shift()), rows["ms"].ne(rows["ms"].shift(-1))
            for r, begins, ends in zip(rows.itertuples(), begin, end, strict=True):
                if job is None:
                    job = {"cadence": int(r.cadence), "state": r.state, "created": whole(r.created), "code_at": whole(r.code_at)}
                elif begins and verdict is not None:
                    pass_to(r.ms)
                if r.status == "completed":
                    if latest_at is None or r.ms > latest_at or (r.ms == latest_at and ahead(r)):
                        latest, latest_at, place = r.conclusion, int(r.ms), whole(r.place)
                    if r.conclusion == "success":
                        ok_at = max(ok_at or 0, int(r.ms))
                if ends:
                    change(max(int(r.ms), latest_at or 0))
        state.update((verdict, latest, latest_at, ok_at, job["cadence"], job["state"], job["created"], job["code_at"], place))
        due, now = _due(job, latest_at, ok_at), state.getCurrentWatermarkMs()
        if due is not None and job["state"] == "active":
            if due > now and _verdict(job, latest, latest_at, ok_at, due) != verdict:
                state.setTimeoutTimestamp(due)
            elif due <= now:
                pass_to(now)
                state.update((verdict, latest, latest_at, ok_at, job["cadence"], job["state"], job["created"], job["code_at"], place))
        if out:
            yield pd.DataFrame(out, columns=["job", "verdict", "at"])

    kept = "verdict string, latest string, latest_at long, ok_at long, cadence long, state string, created long, code_at long, place long"
    return rows.groupBy("job").applyInPandasWithState(told, "job string, verdict string, at timestamp", kept, "append", GroupStateTimeout.EventTimeTimeout)


def health_stream(runs: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """A stream of runs (job, status, conclusion, created_at) → per job and window: runs, failures, the latest run and the latest success."""
    done = runs.where("status = 'completed'").withWatermark("created_at", late)
    return done.groupBy(F.window("created_at", width), "job").agg(
        F.count("*").alias("runs"), F.count_if(~F.col("conclusion").isin("success", "cancelled", "skipped")).alias("failures"),
        F.max("created_at").alias("latest_at"), F.max(F.when(F.col("conclusion") == "success", F.col("created_at"))).alias("ok_at")
    )
