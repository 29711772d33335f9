import numpy as np

from framewright.plans.groups import RADIUS, RHO
from framewright.streaming.lookahead import smooth_stream
from framewright.streaming.tracker import Tracker, track_stream


def drain(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_lookahead_never_truncates(spark, tmp_path):
    v = {c: np.random.default_rng(c).normal(size=9).tolist() for c in (1, 2)}
    rows = [(c, i, v[c][i], i == 8) for c in v for i in range(9)]
    src = tmp_path / "in"
    for k, part in enumerate((rows[:3] + rows[9:10], rows[3:5] + rows[10:14], rows[5:8] + rows[14:])):  # clip 1 lacks its last frame
        spark.createDataFrame(part, "clip long, i int, v double, last boolean").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("clip long, i int, v double, last boolean").option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {(r.clip, r.i): r.v for r in drain(spark, smooth_stream(stream, RHO, RADIUS), "smoothed_clips", tmp_path).collect()}

    def want(c, i):
        w = [(RHO ** abs(k - i), v[c][k]) for k in range(max(0, i - RADIUS), min(8, i + RADIUS) + 1)]
        return sum(a * b for a, b in w) / sum(a for a, _ in w)

    assert set(got) == {(1, i) for i in range(8 - RADIUS)} | {(2, i) for i in range(9)}
    assert all(abs(x - want(*k)) < 1e-12 for k, x in got.items())


def test_tracking_a_stream_is_the_batch_fold(spark, tmp_path):
    r = np.random.default_rng(4)
    base = [r.uniform(0, 100, (6, 2)) for _ in range(3)]
    rows = [(7, f, s, "line", (b + f).tolist()) for f in range(4) for s, b in enumerate(base) if (f + s) % 4 != 3]
    schema = "clip long, frame int, stroke long, type string, p array<array<double>>"
    src = tmp_path / "in"
    for f in range(4):
        spark.createDataFrame([x for x in rows if x[1] == f], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {(r.frame, r.stroke): r.track_id for r in drain(spark, track_stream(stream, 5.0), "tracked_clips", tmp_path).collect()}
    t, want = Tracker(5.0), {}
    for f in range(4):
        part = [x for x in rows if x[1] == f]
        want |= {(f, x[2]): i for x, i in zip(part, t.step([(x[3], np.array(x[4])) for x in part]))}
    assert got == want
