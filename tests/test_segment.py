import pytest

from shoebox.operators import segment
from shoebox.operators.ordering import positions, running_sum, with_previous

SCHEMA = "id long, sort_at double, gps_lat double, gps_lon double, camera_model string, quality double, aesthetic double, width int, height int, user_id long"


def photos(spark, rows):
    full = [(i, *r[:1], *(r[1:] + (None,) * (4 - len(r)))) for i, r in enumerate(rows)]
    return spark.createDataFrame([(*f[:5], 0.5, 0.5, 10, 10, 0) for f in full], SCHEMA)


def sizes(df, *keys):
    return sorted(r["count"] for r in df.groupBy(*keys).count().collect())


@pytest.mark.parametrize("by", [None, ["user_id"]])
def test_time_split(spark, by):
    rows = photos(spark, [(float(t),) for t in (0, 1, 2, 100_000, 100_001, 100_002)])
    assert sizes(segment.segment_events(rows, 3600, 50, by), "event_no") == [3, 3]


@pytest.mark.parametrize("by", [None, ["user_id"]])
def test_gps_split_and_unknown_places(spark, by):
    rows = photos(spark, [(0.0, 40.0, -74.0), (1.0, 40.0, -74.0), (2.0, 48.85, 2.35)])
    assert sizes(segment.segment_events(rows, 3600, 50, by), "event_no") == [1, 2]
    rows = photos(spark, [(0.0, 40.0, -74.0), (1.0,), (2.0, 48.85, 2.35)])
    assert sizes(segment.segment_events(rows, 3600, 50, by), "event_no") == [3]


def test_gap_of_just_the_limit_goes_on(spark):
    rows = photos(spark, [(0.0,), (3600.0,), (7200.5,)])
    assert sizes(segment.segment_events(rows, 3600, 50), "event_no") == [1, 2]


def test_bursts(spark):
    rows = photos(spark, [(0.0, None, None, "A"), (0.5, None, None, "A"), (1.0, None, None, "B"), (60.0, None, None, "B"), (61.0,), (62.0,)])
    found = segment.burst_groups(segment.detect_bursts(segment.segment_events(rows), 2)).collect()
    assert sorted(r["size"] for r in found) == [2, 2]
    assert {r.rep_photo_id for r in found} == {0, 4}


def test_event_groups(spark):
    rows = segment.segment_events(photos(spark, [(0.0,), (1.0,), (90_000.0,)]), 3600)
    got = segment.event_groups(rows).collect()
    assert [(r["size"], r.key, r.start_at, r.end_at, r.rep_photo_id) for r in got] == [(2, "1970-01-01", 0.0, 1.0, 0)]
    assert sorted((r.photo_id, r.rank) for r in segment.members(rows, ["event_no"]).collect()) == [(0, 0.0), (1, 1.0), (2, 0.0)]


def test_empty(spark):
    rows = photos(spark, [(0.0,)]).where("false")
    assert segment.detect_bursts(segment.segment_events(rows)).collect() == []


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_ranges_equal_one_window(spark, ranges):
    """Ties, nulls and many rows: the same as one ordered list."""
    data = [(k, None if k % 41 == 0 else float((k * 7919) % 97), k % 5) for k in range(500)]
    df = spark.createDataFrame(data, "id long, t double, x long")
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = {r.id: r.pos for r in positions(df, "t", "id", ranges=ranges).collect()}
    assert got == {r[0]: k for k, r in enumerate(want)}
    got = {r.id: (r.has_prev, r.prev_x) for r in with_previous(df, ["x"], "t", "id", ranges=ranges).collect()}
    assert got == {r[0]: (k > 0, want[k - 1][2] if k else None) for k, r in enumerate(want)}
    total, sums = 0, {}
    for r in want:
        total += r[2]
        sums[r[0]] = total
    assert {r.id: r.running for r in running_sum(df, "x", "t", "id", ranges=ranges).collect()} == sums
