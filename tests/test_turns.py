import datetime
import os
import random


from sparkloom.streaming import turns as T

START = datetime.datetime(2024, 1, 1)
KIND = "session_id string, turn_number long, at timestamp"


def test_the_stream_lets_go_what_the_fold_says(spark, tmp_path):
    rng = random.Random(3)
    rows, clock = [], {}
    for i in range(400):  # in order of time within a session, and nearly so over all
        s = rng.choice("abcd")
        clock[s] = clock.get(s, 0) + rng.choice([1, 5, 20, 20, 100])
        rows.append((s, i, START + datetime.timedelta(seconds=clock[s])))
    rows.sort(key=lambda r: r[2])
    rows.append(("end", 0, rows[-1][2] + datetime.timedelta(hours=1)))
    for k in range(6):
        part = spark.createDataFrame(rows[k * 70 : (k + 1) * 70], KIND)
        name = str(tmp_path / "in" / f"{k}.parquet")
        os.makedirs(tmp_path / "in", exist_ok=True)
        part.toPandas().to_parquet(name, coerce_timestamps="us", index=False)
        os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    try:
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = T.gone(stream, most=5, idle=60, late="1 second")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    whole = spark.createDataFrame(rows, KIND)
    want = {(r.session_id, r.turn_number, r.why) for r in T.fold(whole, 5, 60).collect() if r.why}
    got = [(r.session_id, r.turn_number, r.why) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {w for *_, w in want} == {"full", "idle"} and T.held(whole, 5, 60).count() == 1


def test_the_fold_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, START + datetime.timedelta(seconds=rng.randint(0, 900))) for i in range(120)]
    out, state = {}, {}
    for s, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        held = state.setdefault(s, [])
        if held and (at - held[-1][1]).total_seconds() > 15:
            out |= {(s, j): "idle" for j, _ in held}
            held.clear()
        held.append((i, at))
        if len(held) > 3:
            out[s, held.pop(0)[0]] = "full"
    now = max(r[2] for r in rows)
    for s, held in state.items():
        out |= {(s, j): "idle" if (now - held[-1][1]).total_seconds() > 15 else None for j, _ in held}
    assert {(r.session_id, r.turn_number): r.why for r in T.fold(spark.createDataFrame(rows, KIND), 3, 15).collect()} == out
    assert T.fold(spark.createDataFrame([], KIND)).count() == 0
