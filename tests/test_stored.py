"""Stored tables: streams that append, tally and merge; days that go; records that name other fields."""

import pytest
from pyspark.sql import functions as F

from meterloom.sources import stores
from meterloom.streaming import sinks
from meterloom.streaming.carried import save_batch

DAY = 86_400_000


def metrics(spark, rows):
    df = spark.createDataFrame(rows, "metric_id bigint, service_id bigint, timestamp_ms bigint")
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stores.REQUEST_METRICS.fields])


def test_a_batch_that_runs_twice_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "m")
    first, second = metrics(spark, [(1, 1, 5), (2, 1, DAY + 5)]), metrics(spark, [(3, 1, DAY + 6)])
    for batch, n in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sinks.save_metrics(batch, n, path)
    assert sorted((r["metric_id"], str(r["dt"]), r["batch_id"]) for r in sinks.read_appended_metrics(spark, path).collect()) == [(1, "1970-01-01", 0), (2, "1970-01-02", 0), (3, "1970-01-02", 1)]


def test_tally_outlives_the_history(spark, tmp_path):
    tally, history = str(tmp_path / "t"), str(tmp_path / "h")
    made = lambda rows: spark.createDataFrame(rows, "restart_id bigint, service_id bigint, trigger_name string, at_ms bigint")
    batches = [made([(i, 1, "flap", i) for i in range(4)]), made([(9, 2, None, 1)]), made([(10, 1, "flap", 10), (11, 1, "age", 11)])]
    for n, batch in enumerate(batches):
        for _ in range(2):
            sinks.save_tally(batch, n, tally)
            sinks.save_history(batch, n, history, cap=3)
    assert sorted((tuple(r) for r in sinks.read_tally(spark, tally, 2).collect()), key=repr) == [(1, "age", 1), (1, "flap", 5), (2, None, 1)]
    assert sorted(r["restart_id"] for r in spark.read.parquet(f"{history}/batch_id=2").collect()) == [3, 9, 10, 11]


def test_live_lines_win_and_late_ones_stay_out(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "service_id bigint, run_id bigint, seq bigint, timestamp_ms bigint, line string, live boolean")
    how, base = sinks.log_union(horizon_ms=100), str(tmp_path / "l")
    batches = [
        made([(1, 1, 0, 1000, "seed", False), (1, 1, 0, 1000, "seed", False), (1, 1, 1, 1001, "early live", True)]),
        made([(1, 1, 0, 1000, "live", True), (1, 1, 1, 1001, "seed again", False), (1, 1, 2, 900, "too late", True), (1, 1, 3, 1200, "new", True)]),
        made([(1, 1, 3, 1201, "newer", True), (1, 1, 0, 1000, "long gone", True)]),
    ]
    for n, batch in enumerate(batches):
        for _ in range(2):
            save_batch(spark, how, base, batch, n)
    got = sinks.current_lines(spark.read.parquet(f"{base}/rows")).collect()
    assert sorted((r["seq"], r["line"]) for r in got) == [(0, "live"), (1, "early live"), (3, "newer")]


def test_days_before_the_cutoff_go(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [(i, "gpu:0", t, 100, 40) for i, t in enumerate((5, DAY + 1, 2 * DAY + 1, 2 * DAY + 9, 3 * DAY))]
    stores.append_device_samples(spark.createDataFrame(rows, "sample_id bigint, device string, timestamp_ms bigint, total_bytes bigint, free_bytes bigint"), path)
    left = lambda: sorted((r["sample_id"], r["used_bytes"]) for r in stores.read_device_samples(spark, path).collect())
    for _ in range(2):
        assert stores.prune_days(spark, path, 2 * DAY + 5) in (["dt=1970-01-01", "dt=1970-01-02"], [])
        assert left() == [(3, 60), (4, 60)]
    assert stores.prune_days(spark, path, 3 * DAY) == ["dt=1970-01-03"] and left() == [(4, 60)]
    assert stores.prune_days(spark, path, 3 * DAY + 1) == ["dt=1970-01-04"] and stores.prune_days(spark, str(tmp_path / "none"), 5) == []


DEEP = "cell string, contexts array<struct<size: bigint, pools: array<struct<mib: double>>>>, cards map<string, struct<used: bigint>>, rss struct<gpu: struct<used: bigint>>, tags array<string>, free map<string, bigint>"
GOOD = '{"cell":"a","contexts":[{"size":1,"pools":[{"mib":1.5}]}],"cards":{"0":{"used":3}},"rss":{"gpu":{"used":1}},"tags":["x","y"],"free":{"any":1}}'


@pytest.mark.parametrize(
    "old, new, path",
    [
        ('"size":1', '"size":1,"odd":2', "contexts[].odd"), ('"mib":1.5', '"mib":1.5,"odd":{}', "contexts[].pools[].odd"), ('{"used":3}', '{"used":3,"odd":null}', "cards{}.odd"),
        ('{"gpu":{"used":1}}', '{"gpu":{"used":1,"odd":[]}}', "rss.gpu.odd"), ('"tags"', '"odd":1,"tags"', "odd"),
    ],
)
def test_unknown_fields_are_refused_at_any_depth(spark, tmp_path, old, new, path):
    schema = stores.T.StructType.fromDDL(DEEP)
    assert old in GOOD
    (tmp_path / "a.ndjson").write_text(GOOD + "\n\n" + GOOD + "\n")
    assert stores.read_ndjson_strict(spark, str(tmp_path), schema).count() == 2
    (tmp_path / "b.ndjson").write_text("\n".join([GOOD, "", GOOD, GOOD.replace(old, new), GOOD.replace(old, new)]))
    with pytest.raises(stores.BadRecord) as error:
        stores.read_ndjson_strict(spark, str(tmp_path), schema)
    assert "b.ndjson:4: unknown field " + path + ": " in str(error.value)


def test_missing_and_null_parts_are_no_unknown_fields(spark, tmp_path):
    schema = stores.T.StructType.fromDDL(DEEP)
    (tmp_path / "a.ndjson").write_text('{"cell":"a"}\n{"cell":"b","contexts":null,"cards":{},"rss":{"gpu":null}}\n{"cell":"c","contexts":[null,{"pools":[]}],"cards":{"x":null}}\n')
    assert stores.read_ndjson_strict(spark, str(tmp_path), schema).count() == 3
