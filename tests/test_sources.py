import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.operators import incremental
from tidemark.operators.resolve import daily
from tidemark.sources import artifacts, gpx, health_xml, importer, sinks
from tidemark.sources.store import Conflict, Store
from tidemark.streaming import ingest as streaming

EXPORT = """<?xml version="1.0" encoding="UTF-8"?>
<HealthData locale="en">
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Watch" unit="count" startDate="2024-01-01 08:00:00 +0100" endDate="2024-01-01 09:00:00 +0100" value="120"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Watch" unit="count" startDate="2024-01-01 08:00:00 +0100" endDate="2024-01-01 09:00:00 +0100" value="120"/>
 <Record type="HKQuantityTypeIdentifierBodyMass" sourceName="Scale" unit="lb" startDate="2024-01-02 08:00:00 +0000" endDate="2024-01-02 08:00:00 +0000" value="200"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Watch" startDate="2024-01-02 23:00:00 +0000" endDate="2024-01-03 06:00:00 +0000" value="HKCategoryValueSleepAnalysisAsleepREM"/>
 <Record type="HKQuantityTypeIdentifierNew" sourceName="Watch" unit="x" startDate="bad" endDate="bad" value="1"/>
 <Correlation type="c"><Record type="HKQuantityTypeIdentifierBodyMass" sourceName="Scale" unit="lb" startDate="2024-01-02 08:00:00 +0000" endDate="2024-01-02 08:00:00 +0000" value="200"/></Correlation>
 <Workout workoutActivityType="HKWorkoutActivityTypeMixedCardio" duration="30" durationUnit="min" sourceName="Watch" startDate="2024-01-03 08:00:00 +0000" endDate="2024-01-03 08:30:00 +0000">
  <WorkoutStatistics type="HKQuantityTypeIdentifierActiveEnergyBurned" sum="412.5" unit="kcal"/>
  <WorkoutStatistics type="HKQuantityTypeIdentifierDistanceWalkingRunning" sum="4203.7" unit="m"/>
  <WorkoutStatistics type="HKQuantityTypeIdentifierHeartRate" average="120" minimum="90" maximum="150" unit="count/min"/>
  <WorkoutStatistics type="HKQuantityTypeIdentifierNobody" sum="1" unit="count"/>
  <WorkoutRoute><FileReference path="/workout-routes/a.gpx"/></WorkoutRoute>
 </Workout>
</HealthData>"""


@pytest.fixture
def export(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("apple_health_export/export.xml", EXPORT)
    (found,) = artifacts.unpack_exports(spark, str(tmp_path / "e.zip"), str(tmp_path / "unpacked"))
    return found


def test_records(spark, export):
    parts = ingest.route_records(spark, health_xml.read_records(spark, export), 1)
    m = {(r["metric"], str(r["start_at"])): r["value"] for r in parts["measurements"].collect()}
    assert m == {("steps", "2024-01-01 07:00:00"): 120, ("body_mass", "2024-01-02 08:00:00"): pytest.approx(90.718474)}
    assert parts["measurements"].count() == 3  # the correlation's copy doesn't count, the repeated row does until keys are compared
    assert [r["state_value"] for r in parts["states"].collect()] == ["asleep_rem"]
    u = parts["unmapped"].first()
    assert (u["source_type"], u["start_at"], u["start_raw"]) == ("HKQuantityTypeIdentifierNew", None, "bad")


def test_import_is_idempotent(spark, export, tmp_path):
    batch = ingest.route_records(spark, health_xml.read_records(spark, export), 1)["measurements"]
    assert sinks.append_measurements(spark, batch, str(tmp_path / "store")).count() == 2
    assert sinks.append_measurements(spark, batch, str(tmp_path / "store")).count() == 2
    seen = ingest.report(batch, sinks.read_family(spark, str(tmp_path / "store"), "measurements"), "measurements", "metric").collect()
    assert {(r["name"], r["added"], r["skipped"]) for r in seen} == {("steps", 0, 2), ("body_mass", 0, 1)}


def test_accounts_never_share_rows(spark, export, tmp_path):
    parts = [ingest.route_records(spark, health_xml.read_records(spark, export), account) for account in (1, 2)]
    for family, n in (("measurements", 2), ("states", 1), ("unmapped", 1)):
        for part in (*parts, *parts):
            stored = sinks.append(spark, part[family], str(tmp_path / "store"), family)
        assert stored.groupBy("account_id").count().orderBy("account_id").collect() == [(1, n), (2, n)]


def test_records_keep_file_order(spark, tmp_path):
    lines = "".join(f'<Record type="HKQuantityTypeIdentifierBodyMass" sourceName="S{k}" unit="kg" startDate="a" endDate="b" value="{k}"/>\n' for k in range(500))
    (tmp_path / "long.xml").write_text(f"<HealthData>\n{lines}</HealthData>")
    found = health_xml.read_records(spark, str(tmp_path / "long.xml")).orderBy("seq").collect()
    assert [r["value"] for r in found] == [str(k) for k in range(500)]


def test_sessions_and_manual_rows_converge(spark, export, tmp_path):
    sessions = health_xml.read_workouts(spark, export)["sessions"].withColumns({"account_id": F.lit(1).cast("bigint"), "seq": F.lit(0)})
    first, second = (sinks.insert_sessions(spark, sessions, str(tmp_path / "store")).collect() for _ in range(2))
    assert first == second and len(first) == 1 and sinks.read_family(spark, str(tmp_path / "store"), "sessions").count() == 1
    now = datetime(2024, 1, 1, 12)
    store = str(tmp_path / "manual")
    row, again = (sinks.add_manual(spark, ingest.manual_entry(spark, 1, "body_mass", 80.0, now, now), store).collect() for _ in range(2))
    assert row == again and len(row) == 1
    sinks.add_manual(spark, ingest.manual_entry(spark, 2, "body_mass", 80.0, now, now), store)
    assert sinks.drop_manual(spark, store, 2, row[0]["id"]) == 0
    assert sinks.drop_manual(spark, store, 1, row[0]["id"]) == 1
    assert [r["account_id"] for r in sinks.read_family(spark, store, "measurements").collect()] == [2]


def test_import_log(spark, tmp_path):
    sinks.record_import(spark, str(tmp_path / "log"), 1, "export.zip", 3, 2, 1, datetime(2024, 1, 1))
    assert spark.read.parquet(str(tmp_path / "log")).first()["skipped_count"] == 2


def test_workouts(spark, export):
    parts = health_xml.read_workouts(spark, export)
    s = parts["sessions"].first()
    assert (s["activity_type"], s["duration"]) == ("mixed_cardio", 1800)
    assert [(r["content_key"], r["route_path"]) for r in parts["routes"].collect()] == [(s["content_key"], "/workout-routes/a.gpx")]
    assert (s["total_distance"], s["total_energy"]) == (pytest.approx(4.2037), pytest.approx(412.5))
    stats = {(r["metric"], r["stat"]): r["value"] for r in parts["session_stats"].collect()}
    assert stats == {("active_energy", "sum"): pytest.approx(412.5), ("distance_walking_running", "sum"): pytest.approx(4.2037), ("heart_rate", "average"): 120, ("heart_rate", "min"): 90, ("heart_rate", "max"): 150}


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx xmlns="x"><trk><trkseg><trkpt lat="48" lon="2"><ele>10</ele><time>2024-01-01T08:00:00Z</time></trkpt></trkseg><trkseg><trkpt lat="49" lon="2"/></trkseg></trk></gpx>')
    rows = gpx.read_tracks(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["lat"], r["ele"], r["at"]) for r in rows] == [(48, 10, datetime(2024, 1, 1, 8)), (49, None, None)]
    (tmp_path / "b.gpx").write_text("<gpx><trk>")
    with pytest.raises(Exception, match="ParseError|no element found"):
        gpx.read_tracks(spark, str(tmp_path)).count()


def test_stream(spark, tmp_path):
    rows = [(1, "steps", 5.0, datetime(2024, 1, 1, 8), "k1"), (1, "steps", 5.0, datetime(2024, 1, 1, 8), "k1"), (1, "steps", 7.0, datetime(2024, 1, 1, 9), "k2")]
    spark.createDataFrame(rows, "account_id bigint, metric string, value double, start_at timestamp, content_key string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streaming.ingest(streaming.distinct_rows(source), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("value")).first()[0] == 12


def test_tsv(spark, tmp_path):
    sinks.write_tsv(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first()["y"] == "a"


DEEP = """<?xml version="1.0"?>
<!DOCTYPE HealthData [ <!ELEMENT HealthData (Record*)> ]>
<HealthData>
 <!-- <Record type="x" value="commented"/> -->
 <Record type='a' sourceName="An &quot;odd&quot; one &amp; &#233;" device="&lt;x>" value="0"><MetadataEntry key="k" value="<"/></Record>
 <Correlation><Correlation><Record type="a" value="twice nested"/></Correlation><Record type="a" value="nested"/></Correlation>
 <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="1" durationUnit="hr" sourceName="W" startDate="2024-01-03 08:00:00 +0000" endDate="2024-01-03 09:00:00 +0000">
  <WorkoutActivity><WorkoutActivity><WorkoutEvent><WorkoutStatistics type="HKQuantityTypeIdentifierHeartRate" average="120" unit="count/min"/></WorkoutEvent></WorkoutActivity></WorkoutActivity>
  <WorkoutRoute sourceName="W" startDate="2024-01-03 08:00:00 +0000" endDate="2024-01-03 08:30:00 +0000"><FileReference path="/workout-routes/a.gpx"/></WorkoutRoute>
  <WorkoutRoute sourceName="V"><MetadataEntry/><FileReference path="./workout-routes/b.gpx"/></WorkoutRoute>
 </Workout>
 <WorkoutStatistics type="HKQuantityTypeIdentifierHeartRate" average="99" unit="count/min"/>
 <Record type="a" value="1"/>
</HealthData>""".replace('value="<"', 'value="&lt;"')


@pytest.fixture
def small_splits(spark):
    """Splits of 100 bytes: most elements lie astride one, and workouts are open over many."""
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_depth_and_parents_over_splits(spark, tmp_path, small_splits):
    (tmp_path / "deep.xml").write_text(DEEP)
    elements = health_xml.read_elements(spark, str(tmp_path / "deep.xml"))
    assert elements.select("seq.split").distinct().count() > 5
    found = health_xml.records(elements).orderBy("seq").collect()
    assert [r["value"] for r in found] == ["0", "1"] and found[0]["source"] == 'An "odd" one & \u00e9'
    parts = health_xml.workouts(elements)
    assert [(r["metric"], r["stat"], r["value"]) for r in parts["session_stats"].collect()] == [("heart_rate", "average", 120)]
    assert [(r["route_path"], r["source"], str(r["end_at"])) for r in parts["routes"].orderBy("seq").collect()] == [("/workout-routes/a.gpx", "W", "2024-01-03 08:30:00"), ("./workout-routes/b.gpx", "V", "None")]
    assert parts["sessions"].count() == 1


def test_splits_say_what_one_split_says(spark, tmp_path, small_splits):
    (tmp_path / "e.xml").write_text(EXPORT)
    rows = lambda: sorted(str(tuple(r)[:-1]) for r in health_xml.read_records(spark, str(tmp_path / "e.xml")).collect())
    cut = rows()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert cut == rows() and len(cut) == 5


def test_artifacts_are_placed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/e.zip", "w") as z:
        z.writestr("apple_health_export/workout-routes/a.gpx", "<gpx>one</gpx>")
        z.writestr("apple_health_export/workout-routes/b.gpx", "<gpx>two</gpx>")
        z.writestr("apple_health_export/other.txt", "no route")
    (tmp_path / "in/c.gpx").write_text("<gpx>one</gpx>")
    store = tmp_path / "routes"
    first = artifacts.store_artifacts(spark, str(tmp_path / "in"), str(store)).collect()
    assert len(first) == 3 and sum(r["written"] for r in first) in (2, 3)
    names = sorted(p.name for p in store.iterdir() if not p.name.endswith(".crc"))
    assert names == sorted({r["artifact"] for r in first}) and len(names) == 2
    times = {p.name: p.stat().st_mtime_ns for p in store.iterdir()}
    again = artifacts.store_artifacts(spark, str(tmp_path / "in"), f"file://{store}")
    assert not any(r["written"] for r in again.collect()) and times == {p.name: p.stat().st_mtime_ns for p in store.iterdir()}
    routes = spark.createDataFrame([("k1", "/workout-routes/a.gpx"), ("k2", "./workout-routes//b.gpx"), ("k3", "/workout-routes/missing.gpx")], "content_key string, route_path string")
    found = {r["content_key"]: r["artifact"] for r in artifacts.routes_of_export(routes, again).collect()}
    of = {r["entry"].rpartition("/")[2]: r["artifact"] for r in first}
    assert found == {"k1": of["a.gpx"], "k2": of["b.gpx"], "k3": None}
    with pytest.raises(ValueError, match="mount"):
        artifacts.store_artifacts(spark, str(tmp_path / "in"), "hdfs://nowhere/x")


def held(store):
    return sorted((r["k"], r["p"]) for r in store.read().collect())


def test_a_lost_commit_loses_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), "family", "p")
    assert store.read() is None
    frame = lambda *ks: spark.createDataFrame([(k, "a b%c" if k % 2 else "x") for k in ks], "k bigint, p string")
    store.append(lambda old: frame(*range(6)))
    store.append(lambda old: frame(6, 7))
    before = held(store)
    one = "k = 3"

    def lost(self, manifest):
        raise RuntimeError("lost between write and swap")

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lost)
        for change in (lambda: store.delete(F.expr(one)), lambda: store.append(lambda old: frame(9)), store.compact):
            with pytest.raises(RuntimeError):
                change()
    assert held(store) == before and store.versions() == [1, 2]
    files = {*store.manifest().files}
    assert store.delete(F.expr(one)) == 1 and held(store) == [r for r in before if r[0] != 3]
    assert len(files - {*store.manifest().files}) <= 2  # only the files of the part that holds the row
    assert store.delete(F.expr(one)) == 0 and store.versions() == [1, 2, 3]
    assert sorted(r["k"] for r in store.read(store.manifest(2)).collect()) == list(range(8))  # the version before is still there
    store.compact()
    assert held(store) == [r for r in before if r[0] != 3]
    assert store.delete(F.expr("true")) == 7 and store.read().count() == 0


def test_commits_that_meet_begin_again(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path), "family", "p") for _ in range(2))
    frame = lambda k: spark.createDataFrame([(k, "a")], "k bigint, p string")
    plain, met = Store._commit, []

    def late(self, manifest):
        if self is store and not met:
            met.append(1)
            other.append(lambda old: frame(2))
        plain(self, manifest)

    monkeypatch.setattr(Store, "_commit", late)
    store.append(lambda old: frame(1))
    assert held(store) == [(1, "a"), (2, "a")]
    with pytest.raises(Conflict):
        plain(store, store.manifest())


def test_daily_table_follows_imports(spark, tmp_path, monkeypatch):
    from tidemark import catalog

    place, rules = str(tmp_path / "store"), catalog.rules(spark)
    kind = "account_id bigint, id bigint, metric string, value double, start_at timestamp_ntz, source string, content_key string, seq bigint"

    def rows(*parts):
        out = []
        for day, hour, metric, value, source in parts:
            out.append((1, hash((day, hour, metric)) % 10**9, metric, float(value), datetime(2024, 1, day, hour), source, f"{day}/{hour}/{metric}/{value}", 0))
        return spark.createDataFrame(out, kind)

    batches = [
        rows((1, 8, "steps", 10, "Watch"), (1, 9, "steps", 5, "Watch"), (2, 8, "heart_rate", 60, "Watch"), (2, 9, "body_mass", 80, "Scale")),
        rows((3, 8, "steps", 7, "Watch"), (2, 9, "heart_rate", 90, "Watch"), (1, 8, "steps", 10, "Watch")),
        rows((2, 7, "body_mass", 81, "Scale"), (2, 20, "body_mass", 79, "Scale"), (2, 21, "body_mass", 78, "Manual")),  # late
    ]
    table = incremental.daily_store(spark, place)
    shown = lambda df: sorted(str((r["account_id"], r["metric"], r["source"], str(r["day"]), r["n"], r["k"], r["total"], r["low"], r["high"], r["latest"])) for r in df.collect())
    whole = lambda: shown(daily(sinks.read_family(spark, place, "measurements"), rules))
    read, plain = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, manifest=None, files=None, file=None: (read.extend(files or []) if self.root.endswith("/daily") else None) or plain(self, manifest, files, file))
    for k, batch in enumerate(batches):
        sinks.append_measurements(spark, batch, place)
        read.clear()
        incremental.follow(spark, place, rules)
        touched = {f.split("/")[1] for f in read}
        assert touched == ({"day=2024-01-02"} if k else set())  # days that the import doesn't touch aren't read
        assert shown(plain(table)) == whole()
    assert incremental.follow(spark, place, rules).version == 3  # nothing new
    manual = sinks.read_family(spark, place, "measurements").filter("source = 'Manual'").first()
    assert sinks.drop_manual(spark, place, 1, manual["id"]) == 1
    incremental.follow(spark, place, rules)
    assert shown(plain(table)) == whole() and not any("Manual" in r for r in whole())


def test_json_rows(spark, tmp_path):
    import json

    sinks.write_json(spark.createDataFrame([(1, None, datetime(2024, 1, 1, 8).date())], "x int, y string, d date"), str(tmp_path / "j"))
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert json.loads(line) == {"x": 1, "y": None, "d": "2024-01-01"}


def test_a_whole_import_and_the_same_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/e.zip", "w") as z:
        z.writestr("apple_health_export/export.xml", EXPORT)
        z.writestr("apple_health_export/workout-routes/a.gpx", "<gpx/>")
    (export,) = artifacts.unpack_exports(spark, str(tmp_path / "in"), str(tmp_path / "unpacked"))
    store = str(tmp_path / "store")
    run = lambda account, path=export: {(r["family"], r["name"]): (r["added"], r["skipped"]) for r in importer.import_export(spark, path, store, account, str(tmp_path / "routes"), str(tmp_path / "in"), datetime(2024, 2, 1)).collect()}
    first = run(1)
    assert first == {("measurements", "steps"): (1, 1), ("measurements", "body_mass"): (1, 0), ("states", "sleep"): (1, 0), ("unmapped", "HKQuantityTypeIdentifierNew"): (1, 0), ("sessions", "mixed_cardio"): (1, 0), ("routes", None): (1, 0)}
    assert {k: v[0] for k, v in run(1).items()} == dict.fromkeys(first, 0)
    log = [tuple(r)[2:5] for r in spark.read.parquet(f"{store}/imports").orderBy(F.desc("added_count")).collect()]
    assert log == [(5, 1, 1), (0, 6, 0)]
    stats = lambda: {(r["metric"], r["stat"]): r["value"] for r in importer.newest_statistics(sinks.read_family(spark, store, "session_stats")).collect()}
    assert len(stats()) == 5 and stats()["heart_rate", "max"] == 150
    later = spark.createDataFrame([(r["account_id"], r["id"], "heart_rate", "max", 155.0) for r in sinks.read_family(spark, store, "sessions").collect()], "account_id bigint, session_id bigint, metric string, stat string, value double")
    importer.put_statistics(spark, later, store)
    assert len(stats()) == 5 and stats()["heart_rate", "max"] == 155
    assert sinks.read_family(spark, store, "sessions").count() == sinks.read_family(spark, store, "routes").count() == 1
