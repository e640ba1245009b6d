import datetime as dt

from voltide.streaming import events as ev


def run(df, mode, spark, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=11 * i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(60)]
    spark.createDataFrame(rows, ev.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: ev.read_events(spark, f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    got = run(ev.tumbling(stream()), "complete", spark, "tumbling")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.tumbling(batch).collect()))
    assert run(ev.sliding(stream()), "complete", spark, "sliding").count() == ev.sliding(batch).count()
    assert run(ev.deduplicated(stream()), "append", spark, "dedup").count() == 60
    totals = {r.user_id: (r.n, r.total) for r in run(ev.running_totals(stream()), "update", spark, "totals").collect()}
    assert totals == {u: (20, sum(float(i) for i in range(60) if i % 3 == u)) for u in range(3)}
    assert ev.sessions(batch).count() > 0
