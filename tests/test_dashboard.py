"""Joins of event, detection and risk rows: what is shuffled for them, and that they keep their rows."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions.parsing import pack_id, unpack_id
from flowloom.operators import dashboard
from flowloom.plans import views
from flowloom.plans.catalog import QUERIES
from flowloom.session import freed_shuffles
from flowloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_events_and_detections_are_made_without_the_edges(spark):
    """Each of the three tables joined all flows with their edges, of which only the risks hold anything."""
    events, detections, risks = views.relational(spark, SF)
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in (events, detections, risks)]
    assert joins == [0, 0, 1]
    scored = views.scored(spark, SF)
    again = views.relational(spark, SF, scored)
    for a, b in zip((events, detections, risks), again):
        assert a.schema.simpleString() == b.schema.simpleString()
        a, b = (x.selectExpr("count(*)", "sum(CAST(xxhash64(*) AS DECIMAL(38, 0)))").first() for x in (a, b))
        assert a == b


def _feed(spark):
    """Events of equal times, without a time, with ids that come twice, and with none, one or two detections and risks."""
    hour = "IF(id % 7 = 0, NULL, TIMESTAMP'2024-01-01 00:00:00' + MAKE_DT_INTERVAL(0, CAST(id % 11 AS INT)))"
    text = "CONCAT('e', LPAD(CAST(id AS STRING), 3, '0'))"
    shown = f"{text} AS id| {hour} AS timestamp| 's' AS source_ip| 1 AS source_port| 'd' AS destination_ip| 2 AS destination_port| 6 AS protocol| 'BENIGN' AS canonical_attack_label| 'live' AS source"
    e = spark.range(90).selectExpr(*shown.split("| "))
    e = e.unionAll(e.filter("id IN ('e010', 'e021')"))
    d = spark.range(90).filter("id % 3 <> 0").selectExpr(f"{text} AS event_id", "id / 90 AS anomaly_score", "id > 40 AS is_anomaly")
    r = spark.range(90).filter("id % 4 <> 0").selectExpr(f"{text} AS event_id", "id % 10 + 0.5 AS risk_score", "'High' AS risk_level")
    return e, d.unionAll(d.filter("event_id = 'e010'")), r.unionAll(r.filter("event_id = 'e021'"))


def _plain_feed(e, d, r, least, limit, offset):
    """The page by nested loops."""
    rows = []
    for x in e.collect():
        of = lambda t, x=x: [y for y in t if y.event_id == x.id] or [None]
        for a in of(d):
            for b in of(r):
                if least is None or (b is not None and b.risk_score >= least):
                    rows.append((x.id, x.timestamp, a and a.anomaly_score, a and a.is_anomaly, b and b.risk_score))
    rows.sort(key=lambda y: y[0], reverse=True)
    rows.sort(key=lambda y: (y[1] is not None, y[1] and y[1].timestamp()), reverse=True)
    return rows[offset : offset + limit]


@pytest.mark.parametrize("limit,offset", [(5, 0), (20, 13), (500, 0)])
def test_the_feed_looks_up_a_page_of_events_only(spark, limit, offset):
    """All events were joined with all detections and all risks to show a page."""
    e, d, r = _feed(spark)
    out = dashboard.threat_feed(e, d, r, None, limit, offset)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2  # per branch of a table
    got = [(x.event_id, x.timestamp, x.anomaly_score, x.is_anomaly, x.risk_score) for x in out.collect()]
    assert got == _plain_feed(e, d.collect(), r.collect(), None, limit, offset)


@pytest.mark.parametrize("limit,offset", [(5, 0), (20, 13), (500, 0)])
def test_the_feed_of_high_risks_looks_up_a_page_of_detections_only(spark, limit, offset):
    e, d, r = _feed(spark)
    out = dashboard.threat_feed(e, d, r, 5.0, limit, offset)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 1 and "Inner" not in plan  # risks were met before the page was cut
    got = [(x.event_id, x.timestamp, x.anomaly_score, x.is_anomaly, x.risk_score) for x in out.collect()]
    assert got == _plain_feed(e, d.collect(), r.collect(), 5.0, limit, offset)


def test_details_shuffle_ids_as_bytes(spark):
    """An id of 32 hex digits was shuffled as text by each of three tables; the ids come back as they were."""
    ids = ["0a1b2c", "0A1B2C", "abc", "", "00", "\x00x", "zz", "é", "ab cd", "10.0.0.1", None]
    rows = spark.createDataFrame([(x,) for x in ids], "id string").withColumn("k", pack_id("id")).withColumn("back", unpack_id("k")).collect()
    assert all(r.back == r.id for r in rows) and len({bytes(r.k) for r in rows if r.id is not None}) == len(ids) - 1
    assert len(spark.sql("SELECT md5('x') AS id").select(pack_id("id").alias("k")).first().k) == 17
    e, d, r = _feed(spark)
    e = e.withColumn("destination_ip", F.lit("d"))
    edges = spark.sql("SELECT 's' src_ip, 'd' dst_ip, 0.5D attack_ratio, 1L attack_flow_count, 2L flow_count, current_timestamp() first_seen, current_timestamp() last_seen, array('x') attack_labels, 1 id")
    out = dashboard.event_details(e, d, r, edges)
    got = out.select("event_id", "anomaly_score", "risk_score").collect()
    assert sorted(map(str, got)) == sorted(f"Row(event_id={x[0]!r}, anomaly_score={x[2]!r}, risk_score={x[4]!r})" for x in _plain_feed(e, d.collect(), r.collect(), None, 1000, 0))
    assert out.schema["event_id"].dataType.simpleString() == "string"


def test_the_three_sinks_are_read_by_packed_ids(spark, tmp_path):
    """Ids were shuffled as text by all three, once more within the uid."""
    scored = views.scored(spark, SF)
    tables.write_scored(scored.limit(500), str(tmp_path), "b")
    events = spark.read.parquet(f"{tmp_path}/events")
    odd = events.limit(1).withColumns({"id": F.lit("odd"), "event_uid": F.lit("another")})
    odd.drop("batch").write.mode("append").parquet(f"{tmp_path}/events/batch=c")
    for t in ("detections", "risk_assessments"):
        one = spark.read.parquet(f"{tmp_path}/{t}").limit(1).withColumns({"id": F.lit("odd"), "event_id": F.lit("odd")})
        one.drop("batch").write.mode("append").parquet(f"{tmp_path}/{t}/batch=c")
    out = tables.read_scored(spark, str(tmp_path))
    assert sorted(x.event_uid for x in out.collect()) == sorted(x.event_uid for x in spark.read.parquet(f"{tmp_path}/events").collect())
    d, x = (spark.read.parquet(f"{tmp_path}/{t}").drop("id") for t in ("detections", "risk_assessments"))
    plain = spark.read.parquet(f"{tmp_path}/events").withColumnRenamed("id", "event_id").join(d, "event_id").join(x, "event_id").select(out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_tables_written_once_leave_no_shuffles(spark):
    """The shuffle of a stored table stayed on disk beside all that was made of it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with freed_shuffles(spark):
        assert spark.conf.get(name) == "true"
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        assert df.count() == 7 and len(df.collect()) == 7 and len(df.collect()) == 7
    assert spark.conf.get(name) == before
    plan = QUERIES["a11"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") >= 3
