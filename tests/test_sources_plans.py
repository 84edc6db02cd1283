import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quakeloom.functions import display, text_guard
from quakeloom.functions.scalar import parse_datetime
from quakeloom.operators import summaries
from quakeloom.operators.dedup import deduplicate_events
from quakeloom.operators.geography import with_region
from quakeloom.operators.magnitude import MagnitudeRule, homogenize_magnitudes, load_rules
from quakeloom.plans import context, pipelines, report
from quakeloom.plans.oracle import statements
from quakeloom.schema import EVENT_COLUMNS, conform, union_events
from quakeloom.sources import bronze, csv_catalogue, fdsn, tables
from quakeloom.sources.synthetic import demo_events
from quakeloom.streaming import ingest

HEADER = (
    "#EventID | Time | Latitude | Longitude | Depth/km | Author | Catalog | Contributor | ContributorID | "
    "MagType | Magnitude | MagAuthor | EventLocationName"
)
LINE = "77|2024-05-06T07:08:09.5|38.5|-9.25|11|ISC||ISC|77|mb|3.4|ISC|Lisbon"


@pytest.fixture(scope="module")
def raw_zone(tmp_path_factory):
    root = tmp_path_factory.mktemp("bronze")

    def put(folder, name, payload, sidecar=True):
        path = root / folder / "2026" / "07" / "20"
        path.mkdir(parents=True, exist_ok=True)
        text = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False, indent=2)
        (path / f"{name}.json").write_text(text, encoding="utf-8")
        if sidecar:
            digest = hashlib.sha256(text.encode()).hexdigest()
            (path / f"{name}.sha256").write_text(digest + "\n")

    put("ipma", "area_7", {"idArea": 7, "data": [
        {"sismoId": "1", "time": "2026-07-19T10:00:00", "lat": "38.1", "lon": "-9.0", "depth": 9, "magnitud": "2,5",
         "magType": "L", "degree": None, "local": "A", "sensed": None},
        {"eventId": "E2", "time": "2026-07-19T11:00:00", "lat": "38.2", "lon": "-9.1", "depth": None, "magnitud": "3.0",
         "degree": "III", "obsRegion": "B", "shakemapref": ""},
        {"eventId": "E3", "time": "not a time", "lat": "38.2", "lon": "-9.1"},
    ]})
    put("ipma", "features", {"features": [
        {"properties": {"id": "F1", "date": "2026-07-01", "hour": "05:06:07", "mag": 1.5}, "geometry": {"coordinates": [-8.5, 37.5]}},
    ]})
    put("ipma", "bare", [{"id": "L1", "time": "13/07/2026 01:02:03", "latitude": 36.0, "longitude": -10.0}])
    put("isc", "events", {"status_code": 200, "content_type": "text/plain",
                          "response_text": f"{HEADER}\n{LINE}\n{HEADER}\n|bad|||||||||||\n\n# Agencies\n# ISC: x\n", "response_url": "u"})
    put("isc", "empty", {"status_code": 204, "response_text": ""})
    put("isc", "html", {"status_code": 200, "response_text": "<!DOCTYPE html><p>no</p>"})
    put("isc", "manifest", {"source": "ISC", "status": "complete"})
    put("ahead", "epica", {"features": [
        {"properties": {"EqID": "Q1", "Year": 1531, "Mo": 1, "Da": 26, "Ho": 4, "Mi": None, "Lat": 38.9, "Lon": -9.0, "Mw": 6.9, "LatUnc": 10, "LonUnc": 20}},
        {"properties": {"EqID": "Q2", "Year": 1755}, "geometry": {"coordinates": [-10.5, 36.5]}},
    ]})
    put("ipma", "broken", "{not json", sidecar=False)
    return str(root)


def test_bronze_to_events(spark, raw_zone):
    events = {r.source_event_id: r for r in bronze.load_bronze(spark, raw_zone).collect()}
    assert set(k for k in events if not k.startswith("MEM-")) == {"E2", "F1", "L1", "77", "Q1", "Q2"}
    first = next(r for k, r in events.items() if k.startswith("MEM-"))
    assert (first.magnitude_value, first.magnitude_type, first.quality_score, first.felt) == (2.5, "L", 0.92, None)
    assert (events["E2"].felt, events["E2"].quality_score, events["E2"].location_text) == (True, 0.82, "B")
    assert events["F1"].latitude == 37.5 and events["F1"].origin_time_utc == datetime(2026, 7, 1, 5, 6, 7)
    assert events["L1"].origin_time_utc == datetime(2026, 7, 13, 1, 2, 3) and events["L1"].magnitude_type == "ML"
    isc = events["77"]
    assert isc.origin_time_utc == datetime(2024, 5, 6, 7, 8, 9, 500000) and isc.record_status == "reviewed"
    assert (isc.depth_km, isc.magnitude_value, isc.location_text, isc.quality_score) == (11.0, 3.4, "Lisbon", 0.92)
    assert events["Q1"].origin_time_utc == datetime(1531, 1, 26, 4, 0) and events["Q1"].location_uncertainty_km == 20
    assert events["Q2"].longitude == -10.5 and events["Q2"].quality_score == 0.58
    assert events["Q2"].origin_time_utc == datetime(1755, 1, 1)


def test_zone_diagnostics(spark, raw_zone):
    snapshots = bronze.read_snapshots(spark, raw_zone)
    counts = {r.source: r.snapshot_count for r in bronze.snapshot_counts(snapshots).collect()}
    assert counts == {"IPMA": 4, "ISC": 4, "AHEAD": 1}
    checks = [r.matches for r in bronze.verify_checksums(spark, raw_zone).collect()]
    assert checks.count(True) == 8 and checks.count(None) == 1
    found = {r.source_file.split("/")[-1]: r for r in fdsn.diagnose(snapshots.filter("source_file like '%/isc/%'"), 1000).collect()}
    assert found["html.json"].parser_error == "html" and found["empty.json"].parser_error is None
    assert found["events.json"].parsed_rows == 2


@pytest.mark.parametrize("body,problem", [
    ("", None), ("Error 400", "error"), ("plain words", "unrecognised"), ("No data found", None),
    ("<?xml version='1.0'?><a/>", "xml"), (HEADER, None), ("EventID,Time\n1,2", None),
])
def test_fdsn_bodies(spark, body, problem):
    frame = spark.createDataFrame([(body,)], "response_text string")
    assert frame.select(fdsn.body_problem(F.col("response_text"))).first()[0] == problem


def test_fdsn_comma_and_header_only(spark):
    frame = spark.createDataFrame(
        [("a", HEADER), ("b", "EventID,Time,Lat,Lon,Mag\n5,2024-01-01T00:00:00,1.5,2.5,NULL")],
        "source_file string, response_text string",
    )
    rows = fdsn.normalise(fdsn.parse_bodies(frame)).collect()
    assert [(r.source_event_id, r.latitude, r.magnitude_value, r.quality_score) for r in rows] == [
        ("5", 1.5, None, pytest.approx(0.76))
    ]


def test_csv_mapping(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text("DataHora,Lat,Lon,M\n01/11/1755 09:40:00,36.5,-10.0,\"8,5\"\nbad,1,2,3\n", encoding="utf-8")
    rows = csv_catalogue.read_historical(
        spark, str(path), {"origin_time_utc": "DataHora", "latitude": "Lat", "longitude": "Lon", "magnitude_value": "M"}
    ).collect()
    assert len(rows) == 1 and rows[0].magnitude_value == 8.5 and rows[0].source == "IPMA_HISTORICAL"
    # month-first wins when both readings are possible
    assert rows[0].origin_time_utc == datetime(1755, 1, 11, 9, 40)


def test_sentinels_and_union(spark):
    raw = spark.createDataFrame(
        [("a", "1755-11-01", "-99", -99.0, 36.0), ("b", None, "5", 11.0, float("nan"))],
        "event_id string, origin_time_utc string, depth_km string, magnitude_value double, latitude double",
    )
    a, b = conform(raw).orderBy("event_id").collect()
    assert (a.depth_km, a.magnitude_value, a.latitude) == (None, None, 36.0)
    assert (b.depth_km, b.magnitude_value, b.latitude, b.is_preferred_record) == (5.0, None, None, True)
    assert union_events([raw, None, raw.drop("depth_km")], spark).count() == 4
    assert union_events([], spark).columns == EVENT_COLUMNS


def test_magnitude_rules(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": {"m l": {"slope": 0.9, "intercept": 0.1}}}))
    assert load_rules(str(path)) == [MagnitudeRule("ML", 0.9, 0.1)]
    frame = spark.createDataFrame(
        [("Mw", 4.2, None), ("ml", 2.0, 0.7), (None, 3.1, None), ("mb", 3.0, None), ("Mw", None, None)],
        "magnitude_type string, magnitude_value double, magnitude_uncertainty double",
    )
    rows = homogenize_magnitudes(frame, load_rules(str(path))).collect()
    assert [(r.magnitude_homogenization_status, r.magnitude_conversion_uncertainty) for r in rows] == [
        ("reviewed_identity", 0.1), ("review_required", 0.7), ("unknown_scale", 0.5), ("review_required", 0.35), ("missing", None),
    ]
    assert rows[1].magnitude_comparable == pytest.approx(1.9) and rows[1].magnitude_conversion_equation == "Mcomp=0.9×M+0.1"


def test_regions_borders_and_overlap(spark):
    points = [(34.0, -10.0), (38.36, -9.0), (38.5, -9.0), (33.8, -10.0), (33.7, -10.0), (None, 1.0)]
    rows = with_region(spark.createDataFrame(points, "latitude double, longitude double")).collect()
    assert [(r._region.name, r._region.confidence) for r in rows] == [
        ("Margem Sudoeste Ibérica", 0.9), ("Vale Inferior do Tejo", 0.85), ("Vale Inferior do Tejo", 0.85),
        ("Margem Sudoeste Ibérica", 0.45), ("Fora dos domínios piloto", 0.2), ("Não classificado", 0.0),
    ]


def test_pipeline_tables_and_report(spark, raw_zone, tmp_path):
    silver, gold = str(tmp_path / "silver"), str(tmp_path / "gold")
    pipelines.build_silver(spark, raw_zone, silver)
    events = tables.load_silver(spark, silver)
    assert events.count() == 7 and events.filter("cluster_role is null").isEmpty()
    assert spark.read.json(f"{silver}.metadata").first().row_count == 7
    demo = demo_events(spark)
    assert demo.count() == 1380 and demo.select("event_id").distinct().count() == 1380
    with pytest.raises(RuntimeError):
        tables.assert_not_stale_demo(demo, True)
    pipelines.build_gold(demo, gold, ("complete",), ("operational", "validated"), (90,), 30)
    states = tables.load_gold(spark, gold)
    assert states.filter("magnitude_policy = 'operational'").count() > 100
    text = report.markdown_report(demo, states, 3)
    assert "| DEMO | 1380 |" in text and "## Estados mais recentes" in text
    report.write_report(demo, states, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/sources")).first()["source"] == "DEMO"
    row = context.build_context(demo, states, "Vale Inferior do Tejo", 90).first()
    facts = json.loads(row["context"])
    assert facts["catalogue"]["sources"] == {"DEMO": 580} and row["left_out"] == []
    assert "latitude" not in row["context"]


def test_context_leaves_out_whole_parts(spark):
    demo = demo_events(spark)
    states = spark.createDataFrame([("Vale Inferior do Tejo", 90, float("nan"), 0.123456, datetime(2020, 1, 1))],
                                   "tectonic_domain string, window_days int, event_rate_per_30d double, maximum_magnitude double, window_end timestamp")
    details = spark.createDataFrame([("x" * 9000,)], "note string")
    whole = context.build_context(demo, states, "Vale Inferior do Tejo", 90, details).first()
    facts = json.loads(whole["context"])
    assert facts["state"] == {"window_end": "2020-01-01T00:00:00Z", "window_days": 90, "maximum_magnitude": 0.1235}
    assert facts["details"]["note"] == "x" * 9000 and list(facts) == ["selection", "catalogue", "state", "details"]
    for characters, left_out in ((5000, ["details"]), (200, ["details", "state", "catalogue"]), (10, ["details", "state", "catalogue", "selection"])):
        row = context.build_context(demo, states, "Vale Inferior do Tejo", 90, details, characters).first()
        assert len(row["context"]) <= characters and json.loads(row["context"]) is not None
        assert row["left_out"][: len(left_out)] == left_out
    nowhere = json.loads(context.build_context(demo, states, "nowhere", 90).first()["context"])
    assert "state" not in nowhere


def test_markdown_escapes_and_says_what_it_leaves_out(spark):
    frame = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert report.markdown_table(frame, 5).splitlines()[-1] == "| a\\|b |  |"
    assert report.markdown_table(spark.range(9), 5).splitlines()[-1] == "Only the first 5 rows are shown."


def test_guard(spark):
    texts = {
        "Um subprojeto do ipma e não é um projeto do IPMA.": False, "Ｐｒｏｊｅｔｏ do\u00a0IPMA": True,
        "Isto é um projeto do IPMA.": True, "Não é um projeto do IPMA.": False,
        "Foi criado pelo IPMA!": True, "Nunca foi mantido pelo IPMA; e a equipa do IPMA criou isto.": True,
        "O IPMA publica dados.": False, "": False,
    }
    frame = spark.createDataFrame(list(texts.items()), "t string, want boolean")
    for r in frame.select("t", "want", text_guard.has_false_attribution(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t
    kept = frame.select(text_guard.enforce_guard(F.col("t"), "corrigido").alias("x")).collect()
    assert [r.x == "corrigido" for r in kept] == list(texts.values())


def test_stream_appends_each_event_once(spark, raw_zone, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        ingest.start(spark, raw_zone, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_dates_month_then_day(spark):
    cases = {"03/04/2020": datetime(2020, 3, 4), "13/04/2020 05:06": datetime(2020, 4, 13, 5, 6),
             "2020-02-30": None, "2020-01-02T03:04:05.678Z": datetime(2020, 1, 2, 3, 4, 5, 678000)}
    frame = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.t for r in frame.select("x", parse_datetime(F.col("x")).alias("t")).collect()} == cases


def test_display_nulls(spark):
    row = spark.range(1).select(
        display.format_number(F.lit(None).cast("double")).alias("a"), display.format_number(F.lit(2.345), 2, " km").alias("b"),
        display.format_boolean_pt(F.lit(None).cast("boolean")).alias("c"), display.format_date_pt(F.lit(None).cast("timestamp")).alias("d"),
        display.response_preview(F.lit("  a \n b  "), 500).alias("e"),
    ).first()
    assert tuple(row) == ("—", "2.35 km", "—", "—", "a b")


def test_long_span_counts_years_and_fraction(spark):
    frame = spark.createDataFrame(
        [(datetime(1000, 1, 1),), (datetime(1755, 11, 1),), (datetime(2026, 1, 1),)], "origin_time_utc timestamp"
    )
    assert [tuple(r) for r in summaries.temporal_aggregation(frame).collect()] == [("1000", 1), ("1755", 1), ("2026", 1)]
    assert summaries.calendar_span(frame).first()[0] == 1026
    assert summaries.fractional_date(frame, 0.5).first()[0].year == 1755


def test_bootstrap_by_brute_force(spark):
    import numpy as np

    values = [float(np.sin(i / 7)) for i in range(57)]
    frame = spark.createDataFrame(
        [("a", i, v, 0.3, 10) for i, v in enumerate(values)] + [("b", i, 1.0, 0.5, None) for i in range(2)] + [(None, i, float(i), 5.0, None) for i in range(30)],
        "k string, window_end int, value double, target double, block int",
    )
    rows = {r.k: r for r in summaries.bootstrap_intervals(frame, ["k"], resamples=200).collect()}
    shares = []
    for r in range(200):
        sample = []
        for b in range(6):
            start = int(hashlib.md5(f"42|{r}|{b}".encode()).hexdigest()[:15], 16) % 48
            sample += values[start:start + 10]
        shares.append(np.mean(np.array(sample[:57]) <= 0.3))
    low, high = np.quantile(shares, [0.025, 0.975])
    got = rows["a"]
    assert (got.boot_lower, got.boot_upper, got.block_length) == (pytest.approx(low), pytest.approx(high), 10)
    assert got.point == pytest.approx(np.mean(np.array(values) <= 0.3))
    assert rows["b"].boot_lower is None and rows["b"].point is None
    assert rows[None].block_length == 3 and rows[None].point == pytest.approx(0.2)


QUICK = [
    "schema_conformance", "stable_event_ids", "scalar_parsing", "magnitude_homogenisation", "region_assignment",
    "domain_epoch_thresholds", "completeness_by_decade", "duplicate_groups", "fingerprints", "replay_baselines",
    "precision_recall", "model_metrics", "density_grid", "fdsn_text", "ipma_json", "ahead_geojson",
    "text_normalisation", "attribution_guard",
]


@pytest.fixture(scope="module")
def database():
    from tests.oracle_check import connect

    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, database, name):
    from tests.oracle_check import compare

    assert compare(spark, database, "/root/testdata/sf0.001", name).startswith("ok")


def test_every_statement_has_a_query():
    import __spark_entry__ as entry

    assert set(statements()) <= set(entry.queries())


def test_folding_is_complete(spark):
    row = spark.range(1).select(text_guard.normalise_text(F.lit("Žluťoučký\u00a0 ﬁn Ａ\u2003é\n")).alias("t")).first()
    assert row.t == "zlutoucky fin a e"


def test_chunks_leave_no_day_out(spark):
    spans = spark.createDataFrame([(datetime(2024, 1, 31), datetime(2024, 7, 15)), (datetime(2024, 5, 1), datetime(2024, 5, 1))], "start timestamp, end timestamp")
    chunks = fdsn.split_ranges(spans, 1).orderBy("chunk_start").collect()
    assert chunks[0].chunk_start == datetime(2024, 1, 31) and chunks[-1].chunk_end == datetime(2024, 7, 15)
    assert all(a.chunk_end == b.chunk_start for a, b in zip(chunks, chunks[1:], strict=False))
    assert chunks[0].chunk_end == datetime(2024, 2, 29)


def test_quotes_and_repeated_headings(spark):
    body = 'EventID,Time,Place,Region\n1,"2020-01-01T00:00:00","LISBON, ""PORTUGAL""",x\n2,2020-01-02,,y'
    rows = fdsn.parse_bodies(spark.createDataFrame([(body,)], "response_text string")).collect()
    assert rows[0].record == {"event_id": "1", "time": "2020-01-01T00:00:00", "location": 'LISBON, "PORTUGAL"'}
    assert rows[1].record["location"] is None
    bodies = spark.createDataFrame([("bad request",), ("x" * 2000 + "\neventid|time\n1|2020",)], "response_text string")
    assert [r.reason for r in fdsn.rejected_bodies(bodies).collect()] == ["error"]


def test_a_renamed_column_is_checked_again(spark):
    events = demo_events(spark).limit(1)
    renamed = events.drop("latitude").withColumn("depth_km", F.lit(500.0))
    passed = conform(renamed).drop("latitude").withColumnRenamed("depth_km", "latitude")
    assert conform(passed).first().latitude is None


def test_large_duplicate_groups_follow_the_one_formula(spark):
    import hashlib

    count = 10_500
    frame = spark.range(count).select(
        F.format_string("id-%05d", "id").alias("event_id"), F.lit("ISC").alias("source"), F.lit(datetime(2020, 1, 1)).alias("origin_time_utc"),
        F.lit(38.0).alias("latitude"), F.lit(-9.0).alias("longitude"), F.lit(3.0).alias("magnitude_value"),
    )
    ids = {r[0] for r in deduplicate_events(frame).select("duplicate_group_id").distinct().collect()}
    names = [f"id-{i:05d}" for i in range(count)]
    parts = [sum(int(hashlib.md5(n.encode()).hexdigest()[k : k + 15], 16) for n in names) for k in (0, 15)]
    text = "|".join(map(str, [count, names[0], names[-1], *parts]))
    assert ids == {"DUP-" + hashlib.sha1(text.encode()).hexdigest()[:12].upper()}


def test_harmonised_csvs_of_the_raw_zone(spark, tmp_path):
    folder = tmp_path / "zone" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text('event_id,origin_time_utc,latitude,longitude,location_text,source\nx1,2020-01-02T03:04:05Z,38.5,-9.5,"Lisbon, ""west""",ISC\nx2,bad,1,2,,\n')
    (folder / "b.csv").write_text("origin_time_utc,event_id_local,depth_km\n2021-01-01,y1,7\n")
    (folder / "c.csv").write_text("id,time\n1,2020\n")
    (folder / "normalised_d.csv").write_text("event_id,origin_time_utc\nz,2020-01-01\n")
    rows = {r.event_id: r for r in csv_catalogue.read_harmonised(spark, str(tmp_path / "zone")).collect()}
    assert set(rows) == {"x1", "x2", "y1"}
    assert rows["x1"].location_text == 'Lisbon, "west"' and rows["x1"].origin_time_utc == datetime(2020, 1, 2, 3, 4, 5) and rows["x1"].latitude == 38.5
    assert rows["x2"].origin_time_utc is None and rows["y1"].depth_km == 7.0 and rows["y1"].source_file.endswith("b.csv")
    assert {r.event_id for r in bronze.load_bronze(spark, str(tmp_path / "zone")).collect()} >= {"x1", "y1"}


def test_chunk_bookkeeping(spark):
    day = lambda n: datetime(2024, n, 1)
    chunks = fdsn.month_chunks(spark, "2024-01-01", "2024-04-01", 1)
    done = spark.createDataFrame([(day(2), day(3))], "chunk_start timestamp, chunk_end timestamp")
    marked = fdsn.chunk_progress(chunks, done).orderBy("chunk_start").collect()
    assert [(r.chunk_start, r.done) for r in marked] == [(day(1), False), (day(2), True), (day(3), False)]
    keys = chunks.select(fdsn.request_key(F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string"), F.lit("b"))).distinct()
    assert keys.count() == 3
    events = conform(spark.createDataFrame(
        [("e", "old", day(1)), ("e", "new", day(1)), ("f", "old", day(1))], "event_id string, source_file string, ingested_at_utc timestamp"
    ))
    assert {(r.event_id, r.source_file) for r in fdsn.combine_chunks(events).collect()} == {("e", "old"), ("f", "old")}


def test_narratives(spark):
    targets = spark.createDataFrame(
        [(1, datetime(2020, 1, 31), 0.42, "época x", 3.5), (2, datetime(2020, 2, 1), None, None, None)],
        "query_id long, window_end timestamp, comparable_percentile_event_rate double, comparison_epoch_label string, comparison_magnitude_threshold double",
    )
    neighbours = spark.createDataFrame(
        [(1, 1, datetime(2015, 5, 5), 0.9, 0.8)], "query_id long, analogue_rank int, window_end timestamp, similarity double, comparability_score double"
    )
    texts = {r.query_id: r.summary for r in report.similarity_summaries(targets, neighbours).collect()}
    assert "42%" in texts[1] and "2015-05-05" in texts[1] and "90.0%" in texts[1] and "M≥3.5" in texts[1]
    assert "n/d" in texts[2] and "Nenhuma" in texts[2]
    scores = spark.createDataFrame(
        [(datetime(2020, 1, 1), 4.0, 30, 0.5, 0.25, None, None, None, 365.25, True)],
        "cutoff timestamp, threshold_magnitude double, horizon_days int, analogue_probability double, historical_rate_probability double,"
        " poisson_probability double, baseline_epoch string, baseline_event_count long, baseline_exposure_days double, observed_outcome boolean",
    )
    text = report.replay_summaries(scores).first().summary
    assert "50.0%" in text and "25.0%" in text and "n/d" in text and "1.0 anos" in text and text.endswith("sim.")


def test_staged_tables_of_a_run_are_deleted(spark):
    from pathlib import Path

    from quakeloom.session import staged, staging

    with staging(spark) as folder:
        assert staged(spark.range(3)).count() == 3
        local = Path(folder.removeprefix("file:"))
        assert any(local.iterdir())
    assert not local.exists()
