"""Streams: verdicts by timers against the batch operator, epochs that are not published twice."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from wardlight.operators.rosters import run_health
from wardlight.streaming import streams as T

DAY0 = dt.datetime(2024, 1, 1)


def day(x):
    return DAY0 + dt.timedelta(days=x)


def batches(spark, schema, *parts):
    path = tempfile.mkdtemp(prefix="spark-")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_time_alone_changes_verdicts(spark):
    """A job that falls silent becomes STALE when the others' runs move the watermark; every change is run_health's verdict at its time."""
    schema = "job string, status string, conclusion string, created_at timestamp"
    done = lambda job, at, c="success": (job, "completed", c, day(at))
    runs = [
        [done("a", 0), done("b", 0.5), ("new", "queued", None, day(1)), done("off", 1)], [done("b", 2, "failure"), done("b", 3)],
        [done("b", k) for k in range(4, 40)] + [done("a", 35, "failure"), done("b", 41)]
    ]
    jobs = spark.createDataFrame(
        [("a", 7, "active", None, None), ("b", 7, "active", None, day(10)), ("new", 3, "active", day(0), None), ("off", 1, "disabled", None, None)],
        "job string, cadence_days int, state string, created timestamp, code_at timestamp"
    )
    out = tempfile.mkdtemp(prefix="spark-")
    found = T.health_verdicts(batches(spark, schema, *runs), jobs, "1 hour")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r.job, r.at, r.verdict) for r in spark.read.parquet(out).collect()))
    assert got == [
        ("a", day(0), "OK"), ("a", day(17), "STALE"), ("a", day(35), "FAILING"), ("b", day(0.5), "OK"), ("b", day(2), "UNPROVEN"), ("b", day(3), "OK"),
        ("new", day(1), "NEW"), ("new", day(4), "SILENT"), ("off", day(1), "DISABLED")
    ]
    everything = spark.createDataFrame([r for part in runs for r in part], schema)
    for job, at, verdict in got:
        now = run_health(everything.where(F.col("created_at") <= F.lit(at)), jobs, F.lit(at)).where(F.col("job") == job).first()
        assert now.verdict == verdict, (job, at)


def test_runs_of_one_time_are_judged_together(spark):
    """Copies of a run and a failed run beside a good one at its time tell one verdict, the same in the batch operator."""
    schema = "job string, status string, conclusion string, created_at timestamp"
    run = lambda at, c: ("a", "completed", c, day(at))
    runs = [run(0, "success"), run(1, "success"), run(1, "failure"), run(1, "cancelled"), run(2, "cancelled"), run(2, "success"), run(3, "success")]
    jobs = spark.createDataFrame(
        [("a", 7, "active", None, None)], "job string, cadence_days int, state string, created timestamp, code_at timestamp"
    )
    out = tempfile.mkdtemp(prefix="spark-")
    found = T.health_verdicts(batches(spark, schema, runs), jobs, "1 hour")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.job, r.at, r.verdict) for r in spark.read.parquet(out).collect())
    assert got == [("a", day(0), "OK"), ("a", day(1), "FAILING"), ("a", day(2), "OK")]
    now = run_health(spark.createDataFrame([r for r in runs if r[3] <= day(1)], schema), jobs, F.lit(day(1))).where("job = 'a'").first()
    assert now.verdict == "FAILING"


def test_of_one_milliseconds_runs_the_first_in_the_table_counts(spark):
    """As in the query's SQL, whose order is by milliseconds: a failed run does not count before one that stands ahead of it, nor in a later batch."""
    import duckdb
    from conftest import same

    from wardlight.plans.registry import ORACLE_SQL, QUERIES

    path = tempfile.mkdtemp(prefix="spark-")
    at = lambda n, us: DAY0 + dt.timedelta(hours=n, microseconds=us)
    # job1 and job2, each with pairs of runs in one millisecond: failed last, failed first, and with one not completed (ids divisible by 9).
    runs = [(1, 0, 0, 1), (4, 5, 1, 1), (5, 5, 9, 1), (7, 30, 0, 1), (10, 60, 3, 1), (12, 60, 700, 1), (13, 90, 0, 1), (45, 95, 0, 1), (46, 95, 1, 1), (2, 1, 0, 2), (8, 2, 0, 2), (15, 2, 5, 2), (18, 40, 0, 2), (20, 40, 0, 2), (22, 99, 0, 2)]
    rows = [(i, at(n, us), u, "view", 1.0, "{}") for i, n, us, u in sorted(runs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet/*.parquet') order by event_id")
    df = QUERIES["t04_health_verdicts"](spark, path)
    assert same(df.collect(), df.columns, con.sql(ORACLE_SQL["t04_health_verdicts"]))
    schema = "job string, status string, conclusion string, created_at timestamp, k long"
    jobs = spark.createDataFrame([("a", 7, "active", None, None)], "job string, cadence_days int, state string, created timestamp, code_at timestamp")
    late = [("a", "completed", "failure", DAY0, 2)], [("a", "completed", "success", DAY0, 1)], [("a", "completed", "failure", DAY0, 3)]
    out = tempfile.mkdtemp(prefix="spark-")
    found = T.health_verdicts(batches(spark, schema, *late), jobs, "1 hour", "k")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.verdict for r in spark.read.parquet(out).collect()) == ["FAILING", "OK"]


def test_a_session_tells_its_newest_row(spark):
    """Of each batch the newest row above all before it, nulls aside."""
    rows = [[("a", 3), ("a", 5), ("a", 5), ("b", None), ("b", 2), ("c", None)], [("a", 4), ("b", 3), ("b", 1), ("c", 0)]]
    out = tempfile.mkdtemp(prefix="spark-")
    found = T.latest_only(batches(spark, "session string, seq long", *rows))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 5), ("b", 2), ("b", 3), ("c", 0)]


def test_an_epoch_is_published_once(spark):
    """Replayed from a lost checkpoint nothing is published again; an epoch that was begun and not finished is repeated, over what it wrote."""
    stream = lambda: batches(spark, "x int", [(1,), (2,)], [(3,)])
    commits, good = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    gate = lambda b: b.select(F.lit("OK").alias("severity"))
    told = []

    def publish(df, epoch):
        T.by_epoch(good)(df, epoch)
        told.append(epoch)
        if told == [0, 1]:
            raise RuntimeError("lost after writing")

    def run():
        T.refresh(stream(), gate, publish, publish, tempfile.mkdtemp(prefix="spark-"), commits=commits).awaitTermination()

    try:
        run()
        raise AssertionError("the first run fails")
    except Exception as e:  # noqa: BLE001
        assert "lost after writing" in str(e)
    run()
    run()
    assert told == [0, 1, 1] and sorted(r.x for r in spark.read.parquet(good).select("x").collect()) == [1, 2, 3]


def test_one_large_collection_is_read_by_several_tasks(spark):
    from wardlight.sources import features as X

    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 0))
    f = spark.range(400).select(F.col("id").alias("feature_id"), F.lit("a],}{").alias("name"), F.lit(1).alias("g"), F.array(F.array(ring)).alias("polygons"))
    path = tempfile.mkdtemp(prefix="spark-") + "/f"
    X.feature_collections(f, "g").select("text").coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found, rejects = X.read_large_features(spark, path, "f", "feature_id")
        assert found.rdd.getNumPartitions() > 3 and rejects.count() == 0
        got = sorted((r.feature_id, str(r.props), str(r.polygons)) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    whole, _ = X.read_features(spark, path, "f", "feature_id")
    assert got == sorted((r.feature_id, str(r.props), str(r.polygons)) for r in whole.collect()) and len(got) == 400


def test_one_placemark_file_is_read_by_several_tasks(spark):
    from wardlight.sources import features as X

    mark = lambda k, n: f"<Placemark><name>m{k}.{n}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 {k},0 {k},{n} 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    folders = "\n".join(f"<Folder>\n<name> f{k} </name>{''.join(mark(k, n) for n in range(1, 4))}\n</Folder>" for k in range(1, 101))
    path = tempfile.mkdtemp(prefix="spark-") + "/one.kml"
    with open(path, "w") as f:
        f.write(f"<kml><Document><name>all</name>{folders}</Document></kml>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = X.read_placemarks(spark, path)
        assert found.rdd.getNumPartitions() > 3
        got = sorted((r.folder, r.name, len(r.polygons[0][0]), r.polygons[0][0][2].y) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == sorted((f"f{k}", f"m{k}.{n}", 4, float(n)) for k in range(1, 101) for n in range(1, 4))


def test_written_geometry_is_compared(spark):
    """A ring that rounds to a point is told, though its key reads back."""
    from wardlight.sources import features as X

    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    big, dot = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 0)), F.array(p(0, 0), p(1e-9, 0), p(1e-9, 1e-9), p(0, 0))
    f = spark.range(3).select(F.col("id").alias("feature_id"), F.lit(1).alias("g"), F.array(F.array(F.when(F.col("id") == 1, dot).otherwise(big))).alias("polygons"))
    assert [r[0] for r in X.write_features(f, tempfile.mkdtemp(prefix="spark-") + "/f", "g").collect()] == ["1"]


def test_shares_of_text_districts(spark):
    from wardlight.operators.geometry import best_share

    s = spark.createDataFrame([("u", "d2", 0.5), ("u", "d1", 0.5), ("v", "d1", 0.2)], "unit string, district string, share double")
    assert sorted(map(tuple, best_share(s, 0.4).collect())) == [("u", "d1", 0.5), ("v", None, 0.2)]
