from __future__ import annotations

import datetime
import os
import uuid

from tokentally.streaming import live

SCHEMA = "agent string, ts timestamp, date string, message_id string, request_id string, input_tokens long, output_tokens long, cost double"


def row(minute, mid="m", tokens=1):
    t = datetime.datetime(2025, 1, 10) + datetime.timedelta(minutes=minute)
    return ("a", t, t.date().isoformat(), mid, "r", tokens, 0, 0.5)


def stream(spark, tmp_path, batches):
    """A file for each batch, taken in order, one at a time."""
    for i, rows in enumerate(batches):
        f = tmp_path / f"in{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(f))
        part = next(f.glob("part-*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, mode, tmp_path):
    return live.run_to_table(df, mode, f"t{uuid.uuid4().hex}", str(tmp_path / "ck"))


def test_daily(spark, tmp_path):
    out = drained(live.daily(stream(spark, tmp_path, [[row(0), row(1)], [row(2, tokens=5), row(1500)]])), "complete", tmp_path).collect()
    assert sorted((r.date, r.records, r.input_tokens) for r in out) == [("2025-01-10", 3, 7), ("2025-01-11", 1, 1)]


def test_blocks(spark, tmp_path):
    out = drained(live.blocks(stream(spark, tmp_path, [[row(0), row(20)], [row(35), row(120)], [row(10_000)]]), gap="30 minutes", watermark="1 hour"), "append", tmp_path).collect()
    assert sorted(((r.block_end - r.block_start).seconds // 60, r.records) for r in out) == [(0, 1), (35, 3)]


def test_first_and_best(spark, tmp_path):
    batches = [[row(0, "a", 3), row(1, "b", 1)], [row(2, "a", 9), row(3, "b", 1)], [row(4, "a", 2)]]
    assert sorted((r.message_id, r.input_tokens) for r in drained(live.deduplicated(stream(spark, tmp_path, batches)), "append", tmp_path).collect()) == [("a", 3), ("b", 1)]
    (tmp_path / "x").mkdir()
    best = drained(live.best_records(stream(spark, tmp_path / "x", batches)), "update", tmp_path / "x").collect()
    assert sorted((r.message_id, r.input_tokens) for r in best) == [("a", 3), ("a", 9), ("b", 1)]


def test_best_prefers_the_main_conversation(spark, tmp_path):
    rows = [(*row(0, "a", 90), True, None), (*row(1, "a", 5), False, None), (*row(2, "a", 5), False, "fast"), (*row(3, "a", 99), True, "fast")]
    schema = SCHEMA + ", is_sidechain boolean, speed string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    best = drained(live.best_records(s), "update", tmp_path).collect()
    assert [(r.input_tokens, r.is_sidechain, r.speed) for r in best] == [(5, False, "fast")]


def test_watch(spark, tmp_path):
    seen = []
    live.watch(stream(spark, tmp_path, [[row(0)], [row(1)]]), lambda df, n: seen.append(df.first().records), str(tmp_path / "ck"), once=True).awaitTermination()
    assert seen == [1, 2]


# Growing log files.


def drained_lines(spark, folder, checkpoint, **options):
    from tokentally.streaming.tail import tail

    out = []

    def take(df, _):
        out.extend((r.file_path.rsplit("/", 1)[1], r.row_id, r.value) for r in df.collect())

    q = tail(spark, [str(folder)], **options).writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(out)


def test_tail_reads_each_line_once(spark, tmp_path):
    """Files grow, appear and are written anew between restarts; an unfinished line waits."""
    logs, ck = tmp_path / "logs", tmp_path / "ck"
    (logs / "deep").mkdir(parents=True)
    (logs / "a.jsonl").write_bytes(b"one\r\n\nt\xc3\xa9\nunfin")
    (logs / "x.txt").write_text("no\n")
    assert drained_lines(spark, logs, ck) == [("a.jsonl", 0, "one"), ("a.jsonl", 6, "té")]
    assert drained_lines(spark, logs, ck) == []
    with (logs / "a.jsonl").open("ab") as f:
        f.write(b"ished\nlast\n")
    (logs / "deep" / "b.jsonl").write_text("b\n" + "y" * 100 + "\n")
    assert drained_lines(spark, logs, ck, split_bytes=7) == [("a.jsonl", 10, "unfinished"), ("a.jsonl", 21, "last"), ("b.jsonl", 0, "b"), ("b.jsonl", 2, "y" * 100)]
    (logs / "a.jsonl").write_text("new\n")
    assert drained_lines(spark, logs, ck) == [("a.jsonl", 0, "new")]


def test_ranges_cover_each_line_once(tmp_path):
    from tokentally.streaming import tail

    data = b"".join(b"x" * (i * 7 % 23) + b"\n" for i in range(200))
    (tmp_path / "f").write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if line:
            want.append((at, line))
        at += len(line) + 1
    for size in (1, 5, 64, 10_000):
        got = []
        with (tmp_path / "f").open("rb") as f:
            for low in range(0, len(data), size):
                for starts, found in tail.lines_between(f, low, min(low + size, len(data)), low == 0):
                    got += zip(starts, found, strict=True)
        assert got == want


CHAIN = SCHEMA + ", is_sidechain boolean, speed string, row_id long"


def test_streamed_side_chain(spark, tmp_path):
    """After each wave, with a restart in between, what is kept is the batch's; state shrinks behind the watermark."""
    import random
    from collections import Counter

    from tests.test_operators import fold
    from tokentally.streaming.changes import best_changes

    rng = random.Random(9)
    records, kept, sizes = [], Counter(), []
    waves = [[(f"m{rng.randrange(30)}", f"r{rng.randrange(3)}", rng.random() < 0.4, rng.randrange(1, 6), rng.choice([None, "fast"])) for _ in range(200)] for _ in range(3)]
    waves[2] += [(None, None, False, 1, None), ("", "r", True, 1, None), (None, None, False, 1, None)]
    waves.append([("late", "r", False, 1, None)])
    (tmp_path / "in").mkdir()

    def take(df, _):
        for r in df.collect():
            kept[(r.message_id, r.request_id, r.is_sidechain, r.input_tokens, r.speed, r.row_id)] += r.change

    for w, wave in enumerate(waves):
        rows = [("a", datetime.datetime(2025, 1, 10 + (10 if w == 3 else w)), "d", m, q, n, 0, 0.5, side, speed, len(records) + i) for i, (m, q, side, n, speed) in enumerate(wave)]
        records += [(m, q, side, n, speed, r[-1]) for (m, q, side, n, speed), r in zip(wave, rows, strict=True)]
        spark.createDataFrame(rows, CHAIN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(CHAIN).parquet(str(tmp_path / "in"))
        q = best_changes(s, ("row_id",), watermark="1 hour", keep_days=3).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(take).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.recentProgress[-1].stateOperators[0].numRowsTotal)
        want = set()
        for m in {r[0] for r in records if r[0]}:
            want |= {(m, k[0], k[1], k[2], k[3]) for k in fold([(r[1], r[2], r[3], r[4]) for r in records if r[0] == m])}
        got = [k for k, n in kept.items() if n]
        assert set(kept.values()) <= {0, 1} and {k[:5] for k in got if k[0]} == want and len([k for k in got if k[0]]) == len(want)
        assert len([k for k in got if not k[0]]) == (3 if w >= 2 else 0)
    assert sizes[2] > 50 and sizes[3] < 5



def test_state_of_a_message_is_read_and_written_once():
    """Each access of state is a round trip: a message of a few requests takes the same number as one of one; further requests have entries of their own."""
    from collections import Counter

    from pyspark.sql import Row
    from pyspark.sql import types as T

    from tokentally.streaming.changes import NEAR, BestRecords

    calls: Counter = Counter()

    class State:
        def __init__(self):
            self.held = {}

        def getValue(self, k):
            calls["state"] += 1
            return self.held.get(k)

        def updateValue(self, k, v):
            calls["state"] += 1
            self.held[k] = v

        def get(self):
            return self.getValue(None)

        def update(self, v):
            self.updateValue(None, v)

    class Handle:
        def getMapState(self, *_):
            return State()

        getValueState = getMapState

        def registerTimer(self, ms):
            pass

        deleteTimer = registerTimer

    kind = T.StructType().add("request_id", T.StringType()).add("is_sidechain", T.BooleanType()).add("input_tokens", T.LongType()).add("speed", T.StringType()).add("ts", T.TimestampType()).add("row_id", T.LongType())

    def waves(n):
        p = BestRecords(kind, ("row_id",), 1000, "ts")
        p.init(Handle())
        out, taken = [], []
        for tokens in (1, 2, 2):
            calls.clear()
            rows = [Row(**dict(zip(kind.names, (f"r{i}", False, tokens, None, datetime.datetime(2025, 1, 1, tokens), i), strict=True))) for i in range(n)]
            out.append(sum(r.change for r in p.handleInputRows(("m",), iter(rows), None)))
            taken.append(calls["state"])
        return out, taken

    assert waves(1) == ([1, 0, 0], waves(20)[1])
    assert waves(20)[0] == [20, 0, 0] and max(waves(20)[1]) <= 4
    assert waves(NEAR + 5)[0] == [NEAR + 5, 0, 0]


def test_cycles_are_written_once(spark, tmp_path):
    """A batch that fails after some rows leaves nothing; run again it is written once; a batch that is committed twice changes nothing."""
    from pyspark.sql import functions as F

    from tokentally.streaming import tail

    tail.register(spark)
    marker = str(tmp_path / "failed")
    s = stream(spark, tmp_path, [[row(0), row(1)], [row(2), row(3), row(4)]])

    @F.udf("long")
    def once(n):
        if n == 7 and not os.path.exists(marker):
            open(marker, "w").close()
            raise ValueError("told to fail")
        return n

    out = s.coalesce(1).select("message_id", once(F.when(F.minute("ts") == 4, 7).otherwise(F.minute("ts"))).alias("n"))

    def run():
        q = out.writeStream.format("tokentally_cycles").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
            return True
        except Exception:  # noqa: BLE001
            return False

    assert run() is False and run() is True and run() is True
    got = sorted((r.batch, r.value) for r in tail.cycles(spark, str(tmp_path / "out")).collect())
    assert got == [(0, '{"message_id": "m", "n": 0}'), (0, '{"message_id": "m", "n": 1}'), (1, '{"message_id": "m", "n": 2}'), (1, '{"message_id": "m", "n": 3}'), (1, '{"message_id": "m", "n": 7}')]
    w = tail.CycleWriter({"path": str(tmp_path / "out")})
    again = w.write(iter([spark.range(1).first()]))
    w.commit([again, None], 1)
    assert sorted((r.batch, r.value) for r in tail.cycles(spark, str(tmp_path / "out")).collect()) == got and not os.path.exists(again.file)


def test_kept_records_as_tables(spark, tmp_path):
    """After each batch what is kept is what going through all records one by one keeps; a batch that runs again changes nothing; a message that wasn't read for long is forgotten."""
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from tests.test_operators import fold
    from tokentally.schema import canonical

    rng, folder, kept, records = random.Random(4), f"file://{tmp_path}/kept", Counter(), []
    for batch in range(4):
        # Messages below 15 have no side chains.
        wave = [(m, f"r{rng.randrange(3)}" if rng.random() < 0.9 else None, m >= 15 and rng.random() < 0.4, rng.randrange(1, 6), rng.choice([None, "fast"])) for m in [rng.randrange(30) for _ in range(150)]]
        rows = [(f"m{m}", q, side, n, speed, f"f{i // 50}", i) for i, (m, q, side, n, speed) in enumerate(wave)]
        records += [(f"m{m}", q or "", side, n, speed) for m, q, side, n, speed in wave]
        rows += [(None, "r", False, 1, None, "f", 1000), ("", None, True, 1, None, "f", 1001), ("", None, True, 1, None, "f", 1002)]
        new = canonical(spark.createDataFrame(rows, "message_id string, request_id string, is_sidechain boolean, input_tokens long, speed string, file_path string, row_id long").withColumn("file_block_start", F.lit(0)).orderBy(F.rand(1)))

        def changes():
            got = live.fold_kept(new, batch, folder).collect()  # noqa: B023
            return Counter({k: n for k, n in sum((Counter({(r.message_id or "", r.request_id or "", r.is_sidechain, r.input_tokens, r.speed): r.change}) if r.change > 0 else Counter() for r in got), Counter()).items()}), Counter((r.message_id or "", r.request_id or "", r.is_sidechain, r.input_tokens, r.speed) for r in got if r.change < 0)

        added, taken = changes()
        assert (added, taken) == changes()
        kept = kept + added
        assert not taken - kept
        kept = kept - taken
        want = Counter()
        for m in {r[0] for r in records}:
            want.update((m, *k[:4]) for k in fold([r[1:] for r in records if r[0] == m]))
        want.update({("", "r", False, 1, None): batch + 1, ("", "", True, 1, None): 2 * (batch + 1)})
        assert kept == want
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["kept-2", "kept-3"]
    late = live.fold_kept(new.where("message_id = 'm0'").limit(1), 4, folder, keep_days=0).collect()
    assert [r.change for r in late] == [1]


def test_the_watcher_keeps_no_state_in_python(spark, tmp_path):
    """Every line is read once, duplicates in other files and waves count once, a restart goes on, and what an earlier version wrote isn't continued."""
    import json
    import shutil

    import pytest

    from tokentally.queries import prices
    from tokentally.sources import claude
    from tokentally.sources.files import Options

    logs, base = tmp_path / "projects" / "p", f"file://{tmp_path}/ck"
    logs.mkdir(parents=True)

    def line(m, r, n, side=False):
        return json.dumps({"timestamp": "2025-01-10T10:00:00Z", "requestId": r, "version": "1.0.0", "isSidechain": side, "message": {"id": m, "model": "click", "usage": {"input_tokens": n, "output_tokens": 0}}}, separators=(",", ":")) + "\n"

    def look():
        q = live.watch_records(claude.ClaudeSource().records(spark, Options(prices(spark)), [str(tmp_path / "projects")]), lambda *_: None, base, once=True)
        q.awaitTermination()
        last = live.last_totals(spark, base).first()
        return (last.records, last.input_tokens, round(last.cost, 9)), [(p.numInputRows, len(p.stateOperators)) for p in q.recentProgress if p.numInputRows]

    (logs / "a.jsonl").write_text(line("m", "r", 5) + line("m", "q", 1) + line("n", "s", 7, True))
    assert look() == ((3, 13, 0.000026), [(3, 0)])
    (logs / "b.jsonl").write_text(line("m", "r", 4) + line("m", "q", 9) + line("n", "s", 2))
    assert look() == ((3, 16, 0.000032), [(3, 0)])
    shutil.rmtree(tmp_path / "ck-kept")
    (logs / "c.jsonl").write_text(line("o", "t", 1))
    with pytest.raises(Exception, match="earlier version"):
        look()
