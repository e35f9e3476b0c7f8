"""Positions kept over several micro-batches, a restart and a micro-batch that is run twice, against a plain loop."""

import datetime as dt
import random

SCHEMA = "pair string, ts timestamp, seq long, event int"
FIRST = dt.datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def given(spark, folder):
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/rows").select("pair", "ts", "position", "n_seen").collect())


def run(spark, folder):
    from tidemark.streaming import bars

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda b, n: bars.held_positions(b, n, folder)).start()
    q.awaitTermination()
    return given(spark, folder)


def loop(batches):
    held, out = {}, []
    for batch in batches:
        for pair, ts, _, event in sorted(batch, key=lambda r: r[1:3]):
            position, seen = held.get(pair, (0, 0))
            held[pair] = (position if event is None else event, seen + 1)
            out.append((pair, ts, *held[pair]))
    return sorted(out)


def test_positions_over_batches_a_restart_and_a_batch_run_twice(spark, tmp_path):
    from tidemark.streaming import bars

    rng, folder = random.Random(3), str(tmp_path)
    # times of days that recur, within a batch and over its edges; pair "c" is silent in the middle, "d" never asks, "e" asks at last
    rows = [(rng.choice("abde" if 100 <= k < 200 else "abcde"), FIRST + dt.timedelta(hours=k // 3), k, rng.choice([0, 1, -1, None, None])) for k in range(300)]
    rows = [(p, ts, k, None if p == "d" or p == "e" and k < 250 else e) for p, ts, k, e in rows]
    batches = [rows[:100], rows[100:200], rows[200:]]
    for b in batches:
        rng.shuffle(b)
    put(spark, folder, batches[0])
    put(spark, folder, batches[1])
    assert run(spark, folder) == loop(batches[:2])
    put(spark, folder, batches[2])
    assert run(spark, folder) == loop(batches)
    bars.held_positions(spark.createDataFrame(batches[2], SCHEMA), 2, folder)
    assert given(spark, folder) == loop(batches)
