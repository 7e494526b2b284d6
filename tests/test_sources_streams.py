"""Frame-range files and ordered folds on streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_shots import RIM, plain
from trackloom.operators.registration import RegistrarRule
from trackloom.operators.shots import ShotConfig
from trackloom.sources import frame_ranges as fr
from trackloom.streaming import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames"))
    rows = [(c, f, o, f + 0.5, 2.0 * o, 20.0, 40.0, 0.9) for c in ("a", "b") for f in range(1, 101) for o in range(3)]
    df = spark.createDataFrame(rows, fr.SCHEMA).repartition(5)
    fr.write_frames(df, path, span=10)
    return path, rows


def test_all_rows_come_back(spark, files):
    path, rows = files
    assert sorted(map(tuple, fr.read_frames(spark, path).collect())) == sorted(rows)


def test_only_asked_ranges_are_opened(spark, files):
    path, rows = files
    plan = fr.read_frames(spark, path).where("frame >= 35 AND frame < 52 AND clip_id = 'b'")
    assert sorted(map(tuple, plan.collect())) == sorted(r for r in rows if 35 <= r[1] < 52 and r[0] == "b")
    assert plan.rdd.getNumPartitions() == 3  # 31-40, 41-50, 51-60 of one clip
    text = plan._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan") :]
    assert "Filter (((frame" not in physical and ">= 35" not in physical.split("BatchScan")[0]
    kept = fr.read_frames(spark, path).where("id = 1 AND frame = 7")
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[1] == 7 and r[2] == 1) and kept.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("start,stop,stride,most", [(1, 101, 1, None), (4, 60, 7, None), (1, 101, 30, 3), (50, 51, 1, 1), (98, 101, 1, 9), (1, 101, 1, 0)])
def test_window_stride_and_limit(spark, files, start, stop, stride, most):
    path, rows = files
    options = {"start": start, "stop": stop, "stride": stride} | ({"max_frames": most} if most is not None else {})
    want = list(range(start, stop, stride))[:most]
    got = fr.read_frames(spark, path, **options)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[1] in want)
    opened = {(f - 1) // 10 for f in want}
    assert got.rdd.getNumPartitions() == max(1, 2 * len(opened))


def run(spark, tmp_path, make, schema, batches, name):
    """What a stream over the batches, one file each, puts out; and the rows it dropped."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03}"))
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        assert q.awaitTermination(240)
        return spark.table(name).collect(), ordered.late_rows(q)
    finally:
        spark.conf.unset(PROVIDER)


T0 = datetime(2024, 1, 1)


def mixed(rows, seed, size=40, back=20):
    """Batches of rows that come up to ``back`` places early or late."""
    r = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + r.uniform(-back / 2, back / 2))
    out = [rows[k] for k in order]
    return [out[k : k + size] for k in range(0, len(out), size)]


def test_shots_in_any_order(spark, tmp_path):
    r = random.Random(1)
    cfg = ShotConfig(timeout=6, cooldown=3, max_gap=0, min_coverage=0.0)
    pts = [None if r.random() < 0.1 else (r.uniform(60, 160), r.uniform(60, 160)) for _ in range(160)]
    want = sorted(plain(pts, RIM, cfg))
    rows = [(1, T0 + timedelta(seconds=i), i, *(pts[i] or (None, None))) for i in range(160)]
    end = [[(2, T0 + timedelta(hours=2 + k), 0, None, None)] for k in range(2)]  # another clip moves the watermark on
    schema = "clip_id long, ts timestamp, i int, bx double, by_ double"
    got, late = run(spark, tmp_path, lambda s: ordered.live_shots(s, RIM, cfg, "30 seconds"), schema, mixed(rows, 3) + end, "shots_any_order")
    assert late == 0 and sorted((x.frame, x.outcome, x.resolved_frame) for x in got if x.clip_id == 1) == want


def test_averages_and_late_rows(spark, tmp_path):
    rule = RegistrarRule(alpha=0.5, max_misses=3)
    r = random.Random(2)
    vals = [None if r.random() < 0.5 else r.random() for _ in range(80)]
    want, e, misses = [], None, 0
    for i, v in enumerate(vals):
        if v is None:
            misses += 1
            e = None if misses > rule.max_misses else e
        else:
            e, misses = (v if e is None else (e + v) / 2), 0
        want.append((i, e, misses))
    rows = [(7, T0 + timedelta(seconds=i), i, vals[i]) for i in range(80)]
    end = [[(8, T0 + timedelta(hours=2), 0, 1.0)], [(7, T0 + timedelta(seconds=5), 5, 9.0)], [(8, T0 + timedelta(hours=4), 1, 1.0)]]
    schema = "clip_id long, ts timestamp, i int, v double"
    got, late = run(spark, tmp_path, lambda s: ordered.live_averages(s, rule, "30 seconds"), schema, mixed(rows, 5) + end, "averages_any_order")
    mine = sorted((x.i, x.e, x.misses) for x in got if x.clip_id == 7)
    assert late == 1 and [(i, m) for i, _, m in mine] == [(i, m) for i, _, m in want]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for (_, a, _), (_, b, _) in zip(mine, want, strict=True))


def test_names_of_files(spark):
    df = spark.createDataFrame([(f,) for f in (1, 10, 11, 1000)], "frame int")
    assert [r[0] for r in df.select(fr.frame_range(df, 10)).collect()] == ["1-10", "1-10", "11-20", "991-1000"]
    assert df.select(F.count("*")).first()[0] == 4
