"""Registered queries over log lines and texts made from the driver's tables: each runs the engine's own parsers, and its SQL says what they should find."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally import render
from tokentally.functions import dates, text
from tokentally.operators import blocks, dedup, report
from tokentally.plans import pricing
from tokentally.queries import _GLOBAL, _HUMAN, _drained, _stream, events, global_blocks, money, prices, query
from tokentally.session import scratch
from tokentally.sources import claude, codex, files, generic, opencode, store
from tokentally.sources.tables import events_usage, table
from tokentally.streaming import changes, live


def e0(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, user_id, model, k, o: as the SQL's e0."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("model"), F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("k"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("o"))


def variant(n: int, *choices: Column | str | int | None) -> Column:
    """The event's choice by its id."""
    out = None
    for i, c in enumerate(choices):
        c = c if isinstance(c, Column) else F.lit(c)
        out = F.when(F.col("event_id") % n == i, c) if out is None else out.when(F.col("event_id") % n == i, c)
    return out


def joined(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def line_frame(e: DataFrame, value: Column, path: Column) -> DataFrame:
    """Lines as the sources read them."""
    return e.select(value.alias("value"), path.alias("file_path"), F.lit(0).cast("bigint").alias("file_block_start"), F.lit("2025-01-01").cast("timestamp").alias("file_time"), F.col("event_id").alias("row_id"))


def iso(form: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    return F.date_format("ts", form)


# Claude, generic and OpenCode lines.


@query(
    """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'er' ELSE 's' || (user_id % 3) END AS session_id, CASE WHEN user_id % 5 = 0 THEN 'pA' ELSE 'p' || (user_id % 7) END AS project,
CASE WHEN user_id % 5 = 0 THEN 'pA/deep' ELSE 'p' || (user_id % 7) END AS project_path, CASE event_id % 8 WHEN 1 THEN model || '-fast' WHEN 2 THEN NULL ELSE model END AS model, CASE WHEN event_id % 8 = 2 THEN '<synthetic>' ELSE model END AS price_model,
date, input_tokens, output_tokens, CAST(CASE WHEN event_id % 8 = 6 THEN 3 + event_id % 5 ELSE event_id % 4 END AS BIGINT) AS cache_creation_tokens, CAST(2 AS BIGINT) AS cache_read_tokens, event_id % 16 = 0 AS is_sidechain FROM e0 WHERE event_id % 8 NOT IN (3, 4, 7)"""
)
def claude_lines(spark, d):
    e = e0(spark, d)
    value = joined(
        '{"timestamp":"', variant(8, *[iso("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")] * 5, iso("yyyy-MM-dd'T'HH:mm:ss"), *[iso()] * 2), '","sessionId":', variant(8, *['"s"'] * 4, "null", *['"s"'] * 3), ',"requestId":"r1","version":"', variant(8, *["1.2.3"] * 3, "v1", *["1.2.3"] * 4),
        '","isSidechain":', F.when(F.col("event_id") % 16 == 0, "true").otherwise("false"), ',"message":{"id":"m', F.col("event_id"), '","model":"', F.when(F.col("event_id") % 8 == 2, "<synthetic>").otherwise(F.col("model")), '","usage":{"input_tokens":', F.col("k"), ',"output_tokens":',
        F.when(F.col("event_id") % 8 == 7, '"x"').otherwise(F.col("o").cast("string")), variant(8, "", ',"speed":"fast"', *[""] * 4, joined(',"cache_creation":{"ephemeral_5m_input_tokens":3,"ephemeral_1h_input_tokens":', F.col("event_id") % 5, "}"), ""), ',"cache_creation_input_tokens":', F.col("event_id") % 4, ',"cache_read_input_tokens":2}}}',
    )
    folder = joined("/h/projects/p", F.col("user_id") % 7, "/s", F.col("user_id") % 3)
    path = F.when(F.col("user_id") % 5 == 0, "/h/projects/pA/deep/er/x.jsonl").when(F.col("user_id") % 2 == 0, joined(folder, ".jsonl")).otherwise(joined(folder, "/subagents/x.jsonl"))
    u = claude.parse_claude(line_frame(e, value, path))
    return u.select(F.col("row_id").alias("event_id"), "session_id", "project", "project_path", "model", "price_model", "date", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "is_sidechain")


def _generic(spark, d, tz="UTC"):
    e = e0(spark, d)
    value = joined('{"timestamp":"', variant(6, iso(), iso("yyyy-MM-dd'T'HH:mm:ss'-05:00'"), iso("yyyy-MM-dd'T'HH:mm:ss"), *[iso()] * 3), '"', variant(6, *[joined(',"sessionId":"u', F.col("user_id"), '"')] * 4, "", ',"sessionId":"z","costUSD":0.25'), ',"message":{"model":"', F.col("model"), '","usage":{"input_tokens":', F.when(F.col("event_id") % 6 == 3, 0).otherwise(F.col("k") + 1), ',"output_tokens":', F.when(F.col("event_id") % 6 == 3, 0).otherwise(F.col("o")), "}}}")
    return generic.parse_generic(line_frame(e, value, F.lit("/x/a.jsonl")), "amp", tz)


_GENERIC_SQL = """, g AS (SELECT e0.*, CASE event_id % 6 WHEN 4 THEN 'unknown' WHEN 5 THEN 'z' ELSE 'u' || user_id END AS session_id, (input_tokens + 1) * i + output_tokens * o AS c, m FROM e0 LEFT JOIN prices p USING (model) WHERE event_id % 6 NOT IN (2, 3))
SELECT event_id, session_id, {date} AS date, model, round(CASE WHEN event_id % 6 = 5 THEN 0.25 WHEN m IS NULL THEN 0 WHEN m = 1 THEN c ELSE round(c * m * 1e8) / 1e8 END, 8) AS cost, m IS NULL AS missing FROM g"""


@query(_GENERIC_SQL.format(date="strftime(CASE WHEN event_id % 6 = 1 THEN ts + INTERVAL 5 HOUR ELSE ts END, '%Y-%m-%d')"))
def generic_lines(spark, d):
    u = pricing.price_usage(_generic(spark, d), prices(spark), "logged")
    return u.select(F.col("row_id").alias("event_id"), "session_id", "date", "model", money("cost", 8).alias("cost"), F.col("missing_pricing_model").isNotNull().alias("missing"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS records FROM e0 WHERE event_id % 6 NOT IN (2, 3) GROUP BY 1")
def dates_as_written(spark, d):
    return report.period_report(_generic(spark, d, "log"), breakdown=False).select("date", "records")


@query(
    """, v AS (SELECT *, row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_id) AS n FROM e0 WHERE event_id % 6 NOT IN (2, 3))
SELECT 'm' || (event_id // 2) AS message_id, event_id, 's' || (user_id % 9) AS session_id, model, model || '-co' AS provider, date, CASE WHEN event_id % 6 = 1 THEN 0 ELSE input_tokens END AS input_tokens, CASE WHEN event_id % 6 = 1 THEN 7 ELSE output_tokens END AS output_tokens,
CAST(CASE WHEN event_id % 6 = 1 THEN 0 ELSE 2 END AS BIGINT) AS cache_creation_tokens, CAST(CASE WHEN event_id % 6 = 1 THEN 0 ELSE 1 END AS BIGINT) AS cache_read_tokens, CASE WHEN event_id % 6 = 4 THEN 0.5 END AS logged_cost FROM v WHERE n = 1"""
)
def opencode_messages(spark, d):
    e = e0(spark, d)
    tokens = F.when(F.col("event_id") % 6 == 1, '{"input":0,"output":0.2,"total":7.9}').otherwise(joined('{"input":', F.col("k"), '.7,"output":', F.col("o"), ',"cache":{"read":1.5,"write":2}}'))
    value = joined('{"id":"m', F.floor(F.col("event_id") / 2), '","sessionID":"s', F.col("user_id") % 9, '","modelID":"', F.col("model"), '","providerID":"', variant(6, *[joined(F.col("model"), "-co")] * 3, "", *[joined(F.col("model"), "-co")] * 2), '"', variant(6, *[joined(',"time":{"created":', F.unix_millis("ts"), "}")] * 2, "", *[joined(',"time":{"created":', F.unix_millis("ts"), "}")] * 3), variant(6, *[""] * 4, ',"cost":0.5', ""), ',"tokens":', tokens, "}")
    raw = line_frame(e, value, F.lit("/x/m.json")).withColumn("id", F.lit(None).cast("string")).withColumn("session_id", F.lit(None).cast("string"))
    u = dedup.first_wins(opencode.parse_opencode(raw), "message_id", ["file_block_start", "file_path", "row_id"])
    return u.select("message_id", F.col("row_id").alias("event_id"), "session_id", "model", "provider", "date", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "logged_cost")


def _document_writer(base: str):
    """Each row (folder, id, data) as a JSON document."""

    def write(batches):
        import os

        made = set()
        for b in batches:
            for r in b.to_pylist():
                place = f"{base}/{r['folder']}/storage/message"
                if place not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(place)
                with open(f"{place}/{r['id']}.json", "w") as f:
                    f.write(r["data"])
            yield b.slice(0, 1).select(["folder"])

    return write


def _database_writer(base: str):
    """Rows (folder, id, session_id, data) sorted by folder into each folder's database, moved to its name when it is whole.  Nothing is held but a batch."""

    def write(batches):
        import os
        import sqlite3
        import uuid

        aside = f".{uuid.uuid4().hex}"  # a task that runs again, or twice, writes its own
        c, folder = None, None

        def end():
            if c is not None:
                c.commit()
                c.close()
                os.replace(f"{base}/{folder}/opencode.db{aside}", f"{base}/{folder}/opencode.db")

        for b in batches:
            rows = b.to_pylist()
            while rows:
                if rows[0]["folder"] != folder:
                    end()
                    folder = rows[0]["folder"]
                    os.makedirs(f"{base}/{folder}", exist_ok=True)
                    c = sqlite3.connect(f"{base}/{folder}/opencode.db{aside}")
                    c.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
                n = next((i for i, r in enumerate(rows) if r["folder"] != folder), len(rows))
                c.executemany("INSERT INTO message VALUES (?, ?, ?)", [(r["id"], r["session_id"], r["data"]) for r in rows[:n]])
                rows = rows[n:]
            yield b.slice(0, 1).select(["folder"])
        end()

    return write


@query("SELECT event_id, 'm' || event_id AS message_id, 's' || (user_id % 9) AS session_id, date, input_tokens + 1 AS input_tokens, output_tokens, event_id % 50 = 0 AND event_id % 100 <> 0 AS from_file FROM e0")
def opencode_folders(spark, d):
    """Four folders, each with a SQLite database and JSON documents: every fiftieth event is a document, half of these are also in the database, whose row is the first.

    A database has one writer, which holds a batch of its rows; documents are written by the tasks that read their events.  All lie in the shared folder.
    """
    base = f"{scratch(spark)}/opencode-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    e = e0(spark, d)
    value = joined('{"id":"m', F.col("event_id"), '","sessionID":"s', F.col("user_id") % 9, '","modelID":"', F.coalesce("model", F.lit("x")), '","providerID":"p","time":{"created":', F.unix_millis("ts"), '},"tokens":{"input":', F.col("k") + 1, ',"output":', F.col("o"), "}}")
    rows = e.select((F.col("event_id") % 4).alias("folder"), "event_id", F.concat(F.lit("m"), F.col("event_id")).alias("id"), F.concat(F.lit("s"), F.col("user_id") % 9).alias("session_id"), value.alias("data"))
    documents = rows.where("event_id % 50 = 0").withColumn("data", F.when(F.col("event_id") % 100 != 0, F.col("data")).otherwise(F.replace("data", F.lit('"output":'), F.lit('"output":99'))))
    documents.select("folder", "id", "data").mapInArrow(_document_writer(base), "folder bigint").count()
    stored = rows.where("event_id % 50 != 0 OR event_id % 100 = 0").repartition("folder").sortWithinPartitions("folder")
    stored.select("folder", "id", "session_id", "data").mapInArrow(_database_writer(base), "folder bigint").count()
    folders = [f"{base}/{r.folder}" for r in rows.select("folder").distinct().collect()]  # four at most
    u = opencode.OpenCodeSource().read(spark, files.Options(prices(spark)), sorted(folders))
    return u.select(F.substring("message_id", 2, 20).cast("bigint").alias("event_id"), "message_id", "session_id", "date", "input_tokens", "output_tokens", F.col("file_path").endswith(".json").alias("from_file"))


# Codex.


def _usage_json(i, c, o) -> Column:
    return joined('{"input_tokens":', i, ',"cached_input_tokens":', c, ',"output_tokens":', o, ',"total_tokens":', i + o, "}")


_CODEX_SQL = """, t AS (SELECT event_id, user_id, ts, model, event_id % 4 AS v, input_tokens * 10 AS i, input_tokens AS c, output_tokens AS o, input_tokens * 10 + output_tokens AS tt FROM e0),
p AS (SELECT *, {prev}
  FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, CASE v WHEN 0 THEN 0 WHEN 2 THEN c ELSE greatest(i - coalesce(pi, 0), 0) END AS ui, CASE WHEN v IN (0, 2) THEN 0 ELSE greatest(c - coalesce(pc, 0), 0) END AS uc, CASE v WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE greatest(o - coalesce(po, 0), 0) END AS uo, CASE v WHEN 0 THEN 0 WHEN 2 THEN c + 1 ELSE greatest(tt - coalesce(pt, 0), 0) END AS ut FROM p),
n AS (SELECT *, greatest(ui, uc, uo, ut) > 0 AS is_event FROM u),
r AS (SELECT *, last_value(CASE WHEN v = 0 OR (v = 3 AND is_event) THEN model END IGNORE NULLS) OVER h AS carried FROM n WINDOW h AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, sum(CASE WHEN is_event AND carried IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS unknown FROM r)
SELECT event_id, 'u' || user_id AS session_id, coalesce(carried, 'gpt-5') AS model, ui AS input_tokens, least(uc, ui) AS cached_tokens, uo AS output_tokens, ut AS total_tokens, carried IS NULL AND unknown = 1 AS is_fallback FROM f WHERE is_event""".format(
    prev=", ".join(f"last_value(CASE WHEN v <> 0 THEN {c} END IGNORE NULLS) OVER w AS p{c[0]}" for c in ("i", "c", "o", "tt"))
)


def _codex_session_lines(spark, d, path) -> DataFrame:
    e, total = e0(spark, d), _usage_json(F.col("k") * 10, F.col("k"), F.col("o"))
    event = lambda *info: joined('{"timestamp":"', iso(), '","type":"event_msg","payload":{"type":"token_count","info":{', *info, "}}}")
    value = variant(4, joined('{"timestamp":"', iso(), '","type":"turn_context","payload":{"model":"', F.col("model"), '"}}'), event('"total_token_usage":', total), event('"last_token_usage":', joined('{"input_tokens":', F.col("k"), ',"output_tokens":1,"total_tokens":', F.col("k") + 1, "}"), ',"total_token_usage":', total), event('"total_token_usage":', total, ',"model_name":" ', F.col("model"), ' "'))
    return line_frame(e, value, path)


_CODEX_EVENT = ["row_id", "session_id", "model", "input_tokens", "cached_tokens", "output_tokens", "total_tokens", "is_fallback"]


@query(_CODEX_SQL)
def codex_sessions(spark, d):
    return codex.parse_codex(_codex_session_lines(spark, d, joined("/x/u", F.col("user_id"), ".jsonl"))).select(*_CODEX_EVENT).withColumnRenamed("row_id", "event_id")


@query(_CODEX_SQL.replace("PARTITION BY user_id", "PARTITION BY (user_id * 0)").replace("'u' || user_id", "'all'"))
def codex_one_file(spark, d):
    """One file of all events, by stretches of 512 lines."""
    return codex.parse_codex(_codex_session_lines(spark, d, F.lit("/x/all.jsonl")), segment_rows=512).select(*_CODEX_EVENT).withColumnRenamed("row_id", "event_id")


@query(
    """, s AS (SELECT event_id, user_id, input_tokens, strftime(ts, '%Y-%m-%dT%H') AS sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e0),
f AS (SELECT user_id, CASE WHEN user_id % 2 = 0 AND max(CASE WHEN n = 1 THEN sec END) = max(CASE WHEN n = 2 THEN sec END) THEN max(CASE WHEN n = 1 THEN sec END) END AS r FROM s GROUP BY user_id),
x AS (SELECT s.user_id, min(n) AS stop FROM s JOIN f USING (user_id) WHERE sec <> r GROUP BY s.user_id)
SELECT s.event_id, s.input_tokens + 1 AS input_tokens FROM s JOIN f USING (user_id) LEFT JOIN x USING (user_id) WHERE NOT coalesce(s.sec = f.r AND (x.stop IS NULL OR s.n < x.stop), false)"""
)
def codex_replays(spark, d):
    e = e0(spark, d)
    value = joined('{"timestamp":"', iso("yyyy-MM-dd'T'HH':00:00Z'"), '","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":', F.col("k") + 1, "}}}}")
    path = joined("/x/u", F.col("user_id"), ".jsonl")
    spawned = line_frame(e.where("user_id % 2 = 0").select((-F.col("user_id") - 1).alias("event_id"), "user_id").distinct(), F.lit('{"note":"thread_spawn"}'), path)
    return codex.parse_codex(line_frame(e, value, path).unionByName(spawned)).select(F.col("row_id").alias("event_id"), "input_tokens")


@query(
    """, t AS (SELECT event_id, ts, event_id % 4 AS v, model, input_tokens AS k, output_tokens AS o FROM e0),
u AS (SELECT event_id, ts, v, model, k AS i, CASE v WHEN 1 THEN 0 WHEN 2 THEN k // 2 WHEN 3 THEN k + 5 ELSE k + 1 END AS c, o, CASE WHEN v = 3 THEN 2 ELSE 0 END AS r FROM t)
SELECT event_id, 'e' || event_id AS session_id, model, i AS input_tokens, CAST(least(c, i) AS BIGINT) AS cached_tokens, o AS output_tokens, CAST(r AS BIGINT) AS reasoning_tokens, CAST(CASE WHEN v = 2 THEN 999 ELSE i + o + r END AS BIGINT) AS total_tokens,
CASE WHEN v = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts_text FROM u WHERE i > 0 OR o > 0 OR c > 0 OR r > 0 OR v = 2"""
)
def codex_headless(spark, d):
    e, k, o = e0(spark, d), F.col("k"), F.col("o")
    head = joined('{"timestamp":"', iso(), '","model":"', F.col("model"), '","usage":{')
    value = variant(
        4, joined(head, '"prompt_tokens":', k, ',"completion_tokens":', o, ',"cached_tokens":', k + 1, "}}"),
        joined('{"created_at":', F.unix_seconds("ts"), ',"data":{"metadata":{"model":"', F.col("model"), '"},"usage":{"input":', k, ',"output":', o, "}}}"),
        joined(head, '"input_tokens":0,"prompt_tokens":', k, ',"cache_read_input_tokens":', F.floor(k / 2), ',"output":', o, ',"total_tokens":999}}'),
        joined(head, '"input_tokens":', k, ',"output_tokens":', o, ',"reasoning_tokens":2,"cached_input_tokens":', k + 5, "}}"),
    )
    out = codex.parse_codex(line_frame(e, value, joined("/x/e", F.col("event_id"), ".jsonl")))
    return out.select(F.col("row_id").alias("event_id"), "session_id", "model", "input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "ts_text")


def _file_writer(base: str):
    """Of batches (file, value) sorted by file: each file below ``base`` line by line, moved to its name when it is whole.  Nothing is held but a batch."""

    def write(batches):
        import os
        import uuid

        import pyarrow as pa

        out, name, written = None, None, 0
        aside = f".{uuid.uuid4().hex}"  # a task that runs again, or twice, writes its own
        for b in batches:
            for file, value in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                if file != name:
                    if out is not None:
                        out.close()
                        os.replace(out.name, f"{base}/{name}")
                    name, written = file, written + 1
                    os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
                    out = open(f"{base}/{name}{aside}", "w")
                out.write(value + "\n")
        if out is not None:
            out.close()
            os.replace(out.name, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    return write


def _written(rows: DataFrame, base: str) -> None:
    """Each file (a path below ``base``) of rows (file, event_id, value), whole, by one task; Spark sorts the lines, and spills."""
    dealt = rows.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value")
    dealt.mapInArrow(_file_writer(base), "files bigint").count()


def _shared_folder(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")


@query("SELECT event_id, 'g' || (user_id % 4) || '/u' || user_id AS session_id, CASE WHEN user_id % 5 = 4 THEN 1000 ELSE 0 END + input_tokens + 1 AS input_tokens, output_tokens FROM e0")
def codex_folders(spark, d):
    """A file for each user in a home's sessions or archive; of those in both, the session's is read.  Ids are paths relative to the folder."""
    e, base = e0(spark, d), _shared_folder(spark, "codex")
    line = lambda more: joined('{"timestamp":"', iso("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '","type":"event_msg","payload":{"type":"token_count","info":{"model":"', F.coalesce("model", F.lit("m")), '","last_token_usage":{"input_tokens":', F.col("k") + 1 + more, ',"output_tokens":', F.col("o"), "}}},\"id\":", F.col("event_id"), "}")
    rest = joined("/g", F.col("user_id") % 4, "/u", F.col("user_id"), ".jsonl")
    live = e.where("user_id % 5 != 4").select(F.concat(F.lit("sessions"), rest).alias("file"), "event_id", line(0).alias("value"))
    kept = e.where("user_id % 3 = 0 OR user_id % 5 = 4").select(F.concat(F.lit("archived_sessions"), rest).alias("file"), "event_id", line(1000).alias("value"))
    _written(live.unionByName(kept), base)
    found = codex.CodexSource().events(spark, [(f"{base}/sessions", base, 0), (f"{base}/archived_sessions", base, 1)])
    # A file's lines are in order of events, so the n-th line is the user's n-th event.
    nth = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(*by)))
    ids = nth(e.select("event_id", joined("g", F.col("user_id") % 4, "/u", F.col("user_id")).alias("session_id")), "event_id")
    return nth(found, "file_block_start", "row_id").join(ids, ["session_id", "n"]).select("event_id", "session_id", "input_tokens", "output_tokens")


@query("SELECT 'u' || user_id AS session_id, 'p3' AS project, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, (SELECT count(DISTINCT user_id) FROM e0 WHERE user_id % 7 = 3) AS files FROM e0 WHERE user_id % 7 = 3 GROUP BY user_id")
def claude_project(spark, d):
    """The logs of one project: the roots come from the environment, and other projects' folders aren't read."""
    import os

    e, base = e0(spark, d), _shared_folder(spark, "claude")
    value = joined('{"timestamp":"', iso(), '","requestId":"r","message":{"id":"m', F.col("event_id"), '","model":"', F.coalesce("model", F.lit("m")), '","usage":{"input_tokens":', F.col("k"), ',"output_tokens":1}}}')
    _written(e.select(joined("projects/p", F.col("user_id") % 7, "/u", F.col("user_id"), ".jsonl").alias("file"), "event_id", value.alias("value")), base)
    before = os.environ.get("CLAUDE_CONFIG_DIR")
    os.environ["CLAUDE_CONFIG_DIR"] = base
    try:
        paths = claude.ClaudeSource().paths("p3")
    finally:
        os.environ.pop("CLAUDE_CONFIG_DIR") if before is None else os.environ.update(CLAUDE_CONFIG_DIR=before)
    read = files.lines(spark, paths).select(F.count_distinct("file_path")).first()[0]
    u = claude.ClaudeSource().read(spark, files.Options(prices(spark), project="p3"), paths)
    return report.session_report(u, breakdown=False).select("session_id", F.lit("p3").alias("project"), "records", "input_tokens", F.lit(read).cast("bigint").alias("files"))


def _codex_events(spark, d) -> DataFrame:
    e = e0(spark, d)
    return e.select(F.col("user_id").cast("string").alias("session_id"), iso().alias("ts_text"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("model")).alias("model"), (F.col("k") + F.col("o")).alias("input_tokens"), F.col("k").alias("cached_tokens"), F.col("o").alias("output_tokens"), F.lit(1).cast("bigint").alias("reasoning_tokens"), (F.col("k") + 2 * F.col("o")).alias("total_tokens"), (F.col("event_id") % 50 == 0).alias("is_fallback"), F.lit("/x").alias("file_path"), F.lit(0).cast("bigint").alias("file_block_start"), F.col("event_id").alias("row_id"))


_CODEX_SUMS = "CAST(sum(input_tokens + output_tokens) AS BIGINT) AS input_tokens, CAST(sum(input_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS reasoning_tokens, CAST(sum(input_tokens + 2 * output_tokens) AS BIGINT) AS total_tokens, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS last_activity"
_CODEX_COLUMNS = ["input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "last_activity"]


@query(f"SELECT date AS period, model, {_CODEX_SUMS}, bool_or(event_id % 50 = 0) AS is_fallback FROM e0 WHERE event_id % 11 <> 0 GROUP BY 1, 2")
def codex_by_day_and_model(spark, d):
    return codex.group_events(_codex_events(spark, d)).select("period", "model", *_CODEX_COLUMNS, "is_fallback")


@query(f"SELECT CAST(user_id AS VARCHAR) AS period, model, {_CODEX_SUMS}, bool_or(event_id % 50 = 0) AS is_fallback FROM e0 WHERE event_id % 11 <> 0 GROUP BY 1, 2")
def codex_by_session_and_model(spark, d):
    return codex.group_events(_codex_events(spark, d), "session").select("period", "model", *_CODEX_COLUMNS, "is_fallback")


_CODEX_COST = "coalesce(output_tokens * i + input_tokens * CASE model WHEN 'click' THEN 0.5e-6 WHEN 'view' THEN 0.1e-6 WHEN 'purchase' THEN 0.5e-6 ELSE 0.3e-6 END + output_tokens * o, 0)"


@query(f"SELECT date[1:7] AS period, {_CODEX_SUMS}, round(sum({_CODEX_COST}), 6) AS cost, string_agg(DISTINCT model, ',' ORDER BY model) AS models, bool_or(event_id % 50 = 0) AS fallbacks FROM e0 LEFT JOIN prices USING (model) WHERE event_id % 11 <> 0 AND date BETWEEN '2024-01-03' AND '2024-02-20' GROUP BY 1")
def codex_period_report(spark, d):
    r = codex.codex_report(_codex_events(spark, d), prices(spark), "monthly", since="2024-01-03", until="20240220")
    return r.select("period", *_CODEX_COLUMNS, money("cost", 6).alias("cost"), F.array_join(F.map_keys("models"), ",").alias("models"), F.exists(F.map_values("models"), lambda m: m["is_fallback"]).alias("fallbacks"))


@query(f"SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, date, output_tokens AS input_tokens, input_tokens AS cache_read_tokens, round({_CODEX_COST} * CASE WHEN m = 1 THEN 2 ELSE coalesce(m, 1) END, 8) AS cost, m IS NULL AS missing FROM e0 LEFT JOIN prices USING (model) WHERE event_id % 11 <> 0")
def codex_usage_fast(spark, d):
    u = codex.to_usage(_codex_events(spark, d), prices(spark), fast=True)
    return u.select(F.col("row_id").alias("event_id"), "session_id", "date", "input_tokens", "cache_read_tokens", money("cost", 8).alias("cost"), F.col("missing_pricing_model").isNotNull().alias("missing"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN 'session' WHEN event_id % 4 = 1 THEN 'headless' END AS kind FROM events")
def codex_line_kinds(spark, d):
    value = variant(4, '{"type":"turn_context","x":1}', '{"result":{"usage":{}}}', '{"type":"event_msg","payload":{"type":"agent"}}', '{"a":"event_msg","b":"token_count"}')
    return e0(spark, d).select("event_id", codex.kind(value).alias("kind"))


# Files.


@query("SELECT 'p' || (user_id % 7) AS project, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM e0 GROUP BY 1")
def log_files(spark, d):
    """Lines written to folders by project and read again, in recursion, with their places."""
    folder = f"{scratch(spark)}/logs-{uuid.uuid4().hex}"
    e = e0(spark, d).withColumn("project", joined("p", F.col("user_id") % 7))
    e.select("project", joined('{"id":', F.col("event_id"), ',"k":', F.col("k"), "}", F.when(F.col("event_id") % 2 == 0, "\r").otherwise("")).alias("value")).write.partitionBy("project").option("lineSep", "\n").text(folder)
    read = files.lines(spark, [folder], "part-*")
    project = F.regexp_extract("file_path", "project=([^/]+)/", 1)
    per = read.groupBy(project.alias("project")).agg(F.count("*").alias("lines"), F.count_distinct("file_path", "file_block_start", "row_id").alias("places"), F.sum(F.get_json_object("value", "$.id").cast("bigint")).alias("ids"), F.sum(F.get_json_object("value", "$.k").cast("bigint")).alias("input_tokens"))
    return per.select("project", F.when(F.col("lines") == F.col("places"), F.col("lines")).alias("lines"), "ids", "input_tokens")


# Deduplication.


@query("SELECT message_id, event_id, total FROM (SELECT user_id || '-' || model AS message_id, event_id, input_tokens + output_tokens AS total, row_number() OVER (PARTITION BY user_id, model ORDER BY event_id % 3 = 0, CAST((input_tokens + output_tokens) // 20 AS BIGINT) DESC, event_id % 2 = 0, event_id) AS n FROM e0) WHERE n = 1")
def dedup_sidechain_and_speed(spark, d):
    """The main conversation's before a side chain's, more tokens (here in twenties), a known speed, the earlier."""
    u = events_usage(spark, d).withColumn("real", F.col("input_tokens") + F.col("output_tokens"))
    u = u.withColumn("message_id", F.concat_ws("-", "session_id", "model")).withColumn("is_sidechain", F.col("row_id") % 3 == 0).withColumn("speed", F.when(F.col("row_id") % 2 == 1, "fast"))
    u = u.withColumn("input_tokens", F.floor(F.col("real") / 20).cast("bigint")).withColumn("output_tokens", F.lit(0).cast("bigint")).withColumn("version", F.col("real").cast("string")).drop("real")
    return dedup.best_records(u, ("row_id",)).select("message_id", F.col("row_id").alias("event_id"), F.col("version").cast("bigint").alias("total"))


_KEPT = "[struct_pack(rid := 'r', side := false, total := 0::BIGINT, id := 0::BIGINT)][1:0]"
_BETTER = "CASE WHEN r.side <> x.side THEN NOT r.side ELSE r.total > x.total END"
_SWAP = "list_transform(k.kept, lambda x, i: CASE WHEN i = {at} AND " + _BETTER + " THEN r.rec ELSE x END)"


def _fold_sql() -> str:
    at = "list_position(list_transform(k.kept, lambda x: x.rid), r.rid)"
    side = "list_position(list_transform(k.kept, lambda x: x.side), true)"
    step = f"CASE WHEN {at} IS NOT NULL AND {at} > 0 THEN {_SWAP.format(at=at)} WHEN r.side AND {side} IS NOT NULL AND {side} > 0 THEN {_SWAP.format(at=side)} ELSE list_append(k.kept, r.rec) END"
    return f"""WITH RECURSIVE r AS (SELECT event_id % 500 AS m, 'r' || (event_id % 3) AS rid, event_id % 4 = 0 AS side, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) + CAST(floor(coalesce(value, 0)) AS BIGINT) AS total, row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id) AS n,
  struct_pack(rid := 'r' || (event_id % 3), side := event_id % 4 = 0, total := coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) + CAST(floor(coalesce(value, 0)) AS BIGINT), id := event_id) AS rec FROM events),
k(m, n, kept) AS (SELECT DISTINCT m, 0::BIGINT, {_KEPT} FROM r UNION ALL SELECT k.m, r.n, {step} FROM k JOIN r ON r.m = k.m AND r.n = k.n + 1),
f AS (SELECT m, unnest(kept) AS x FROM (SELECT m, kept, row_number() OVER (PARTITION BY m ORDER BY n DESC) AS q FROM k) WHERE q = 1)
SELECT CAST(m AS VARCHAR) AS message_id, x.rid AS request_id, x.side AS is_sidechain, x.id AS row_id, x.total AS total FROM f"""


SIDECHAIN_SQL = _fold_sql()


@query("SELECT message_id, request_id, event_id, total FROM (SELECT CAST(user_id AS VARCHAR) AS message_id, model AS request_id, CAST(event_id AS VARCHAR) AS event_id, input_tokens + output_tokens AS total, row_number() OVER (PARTITION BY user_id, model ORDER BY input_tokens + output_tokens DESC, ts, event_id) AS n FROM e0) WHERE n = 1")
def stream_best(spark, d):
    s = _stream(spark, d)
    s = s.withColumn("event_id", F.col("message_id")).withColumn("message_id", F.col("user")).drop("user")
    return _drained(spark, live.best_records(s, watermark="60 days"), "update").select("message_id", "request_id", "event_id", (F.col("input_tokens") + F.col("output_tokens")).alias("total"))


_WAVES = """, s AS (SELECT *, event_id % 3 AS wave FROM e0)
SELECT 'p' || (user_id % 7) AS project, model, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, (SELECT count(*) + count(*) FILTER (event_id % 5 = 0) FROM e0) AS lines FROM s GROUP BY 1, 2"""


@query(_WAVES)
def watched_logs(spark, d):
    """Claude lines written in three waves, each followed by the watcher, which stops and restarts on one checkpoint in between.

    A message has 20 requests; every fifth is logged twice, in another file and wave, with fewer tokens first.  ``lines`` is what was read in all.
    """
    base = f"{scratch(spark)}/waves-{uuid.uuid4().hex}"
    folder, checkpoint, read = f"{base}/projects", f"{base}/checkpoint", []
    e = e0(spark, d)
    twice = e.where("event_id % 5 = 0")
    every = e.withColumn("wave", F.col("event_id") % 3).unionByName(twice.withColumn("wave", (F.col("event_id") + 1) % 3).withColumn("o", F.lit(-1).cast("bigint")))
    shown = F.greatest("o", F.lit(0))
    value = joined('{"timestamp":"', iso("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '","requestId":"r', F.col("event_id") % 20, '","version":"1.0.0","message":{"id":"m', F.floor(F.col("event_id") / 20), '","model":"', F.col("model"), '","usage":{"input_tokens":', F.when(F.col("o") < 0, 0).otherwise(F.col("k")), ',"output_tokens":', shown, "}}}")
    source, options = claude.ClaudeSource(), files.Options(prices(spark))
    for wave in range(3):
        own = every.where(F.col("wave") == wave).select(joined("p", F.col("user_id") % 7).alias("project"), value.alias("value"))
        own.write.mode("append").partitionBy("project").text(folder)
        q = live.watch_records(source.records(spark, options, [folder], pattern="part-*"), lambda totals, n: None, checkpoint, once=True)
        q.awaitTermination()
        read += [p.numInputRows for p in q.recentProgress]
    totals = live.last_totals(spark, checkpoint)
    return totals.select(F.regexp_replace("project", "^project=", "").alias("project"), "model", "records", "input_tokens", "output_tokens", F.lit(sum(read)).cast("bigint").alias("lines"))


@query()
def stream_side_chain(spark, d):
    """The side-chain fold as a stream: three waves of records, a restart between them, and what is kept in the end."""
    base = f"{scratch(spark)}/chain-{uuid.uuid4().hex}"
    u = events_usage(spark, d).withColumn("message_id", (F.col("row_id") % 500).cast("string")).withColumn("request_id", F.concat(F.lit("r"), (F.col("row_id") % 3).cast("string"))).withColumn("is_sidechain", F.col("row_id") % 4 == 0)
    last = u.agg(F.max("row_id").alias("m")).first().m or 0
    for wave in range(3):
        third = (F.col("row_id") * 3 >= F.lit(wave) * (last + 1)) & (F.col("row_id") * 3 < F.lit(wave + 1) * (last + 1))
        u.where(third).write.mode("append").parquet(f"{base}/in")
        s = spark.readStream.schema(u.schema).parquet(f"{base}/in")
        live.run_to_table(changes.best_changes(s, ("row_id",), watermark="60 days"), "append", "out", f"{base}/checkpoint")
    out = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/checkpoint-out")
    kept = out.groupBy("message_id", "request_id", "is_sidechain", "row_id", dedup.total_tokens().alias("total")).agg(F.sum("change").alias("n")).where("n != 0")
    return kept.select("message_id", "request_id", "is_sidechain", "row_id", (F.col("total") * F.col("n")).alias("total"))


_LAG_SQL = """, a AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'fast' ELSE 'slow' END AS agent, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS third FROM e0),
w AS (SELECT third, max(ts) FILTER (agent = 'fast') - INTERVAL 1 HOUR AS fast, max(ts) FILTER (agent = 'slow') - INTERVAL 1 DAY AS slow FROM a GROUP BY third),
-- The slow agent's third comes a wave after the fast one's; with the policy max the fast one's watermark holds for both.
k AS (SELECT a.*, a.agent = 'slow' AND (SELECT w.fast FROM w WHERE w.third = a.third) >= date_trunc('day', ts) + INTERVAL 1 DAY AS late FROM a)
"""


@query(
    _LAG_SQL + """SELECT 'min' AS policy, agent, date, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM k GROUP BY ALL
UNION ALL SELECT 'max', agent, date, count(*), CAST(sum(input_tokens) AS BIGINT) FROM k WHERE NOT late GROUP BY ALL"""
)
def stream_agents(spark, d):
    """Two agents' streams in one query, of which one lags a third of the time behind: by the slowest one's watermark no row is lost, by the fastest one's those of closed days are."""
    e = e0(spark, d).withColumn("third", F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2))
    e = e.withColumn("agent", F.when(F.col("event_id") % 2 == 0, "fast").otherwise("slow")).select("third", "agent", "ts", F.col("k").alias("input_tokens"), F.col("o").alias("output_tokens"))
    out = None
    for policy in ("min", "max"):
        base = f"{scratch(spark)}/agents-{uuid.uuid4().hex}"
        for wave in range(5):
            for agent, third in (("fast", wave), ("slow", wave - 1)):
                own = e.where((F.col("agent") == agent) & (F.col("third") == third)).drop("third")
                if wave == 4:  # what closes the last days
                    own = e.limit(1).select(F.lit(agent).alias("agent"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"))
                own.write.mode("append").parquet(f"{base}/{agent}")
            streams = {a: spark.readStream.schema(own.schema).parquet(f"{base}/{a}").drop("agent") for a in ("fast", "slow")}
            live.run_to_table(live.closed_days(live.agents(streams, {"fast": "1 hour", "slow": "1 day"}, policy=policy)), "append", "out", f"{base}/checkpoint")
        days = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/checkpoint-out").where("date < '2030'").select(F.lit(policy).alias("policy"), "agent", "date", "records", "input_tokens")
        out = days if out is None else out.unionByName(days)
    spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")
    return out


# Prices.


_BRANDS = """, b AS (SELECT p_brand AS model, p_brand[1:7] AS mfgr, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, CAST(right(p_brand, 1) AS INTEGER) AS digit FROM part GROUP BY 1, 2)
"""
_RATES = ["input", "output", "cache_create", "cache_read", "input_above"]


def brands(spark, d) -> DataFrame:
    """A price list made from the parts: model, mfgr, n, s (prices for a million tokens), digit."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("model"), F.left("p_brand", F.lit(7)).alias("mfgr")).agg(F.count("*").alias("n"), F.sum("p_size").cast("bigint").alias("s")).withColumn("digit", F.right("model", F.lit(1)).cast("int"))


def document(spark, entries: DataFrame, entry: Column, key: str = "model", within: str | None = None) -> str:
    """The path of one JSON document {key: entry, ...}, or {within: {...}}, written from rows."""
    path = f"{scratch(spark)}/prices-{uuid.uuid4().hex}"
    whole = F.map_from_entries(F.collect_list(F.struct(F.col(key), entry.alias("entry"))))
    doc = entries.agg(whole.alias("m"))
    doc.select(F.to_json(F.create_map(F.lit(within), "m") if within else F.col("m")).alias("value")).coalesce(1).write.text(path)
    return path


def _rates(p: DataFrame) -> DataFrame:
    return p.select("model", *[F.round(F.col(c) * 1e6, 6).alias(c) for c in _RATES], "multiplier", "context_limit")


def _per_token(c: str) -> Column:
    return F.col(c) / 1e6


@query(
    _BRANDS + """SELECT model, n::DOUBLE AS input, s::DOUBLE AS output, CASE WHEN digit % 2 = 0 THEN n * 2.0 ELSE n * 1.25 END::DOUBLE AS cache_create, round(n * 0.1, 6)::DOUBLE AS cache_read, CASE WHEN digit % 2 = 0 THEN s * 2.0 END::DOUBLE AS input_above, CASE WHEN digit = 2 THEN 6.0 ELSE 1.0 END::DOUBLE AS multiplier, s AS context_limit FROM b WHERE digit <> 5"""
)
def litellm_prices(spark, d):
    """Both shapes of a cost map, by the brand's digit; brands of digit 5 have no output price and are left out."""
    full = {"input_cost_per_token": _per_token("n"), "output_cost_per_token": F.when(F.col("digit") != 5, _per_token("s")), "cache_creation_input_token_cost": F.col("n") * 2 / 1e6, "input_cost_per_token_above_200k_tokens": F.col("s") * 2 / 1e6, "max_input_tokens": F.col("s"), "provider_specific_entry": F.when(F.col("digit") == 2, F.struct(F.lit(6.0).alias("fast")))}
    short = {"i": _per_token("n"), "o": _per_token("s"), "ctx": F.col("s")}
    odd = (F.col("digit") % 2 == 1) & (F.col("digit") != 5)
    entry = F.struct(*[F.when(~odd, v).alias(k) for k, v in full.items()], *[F.when(odd, v).alias(k) for k, v in short.items()])
    return _rates(pricing.from_litellm(spark, document(spark, brands(spark, d), entry)))


@query(_BRANDS + "SELECT model, n::DOUBLE AS input, s::DOUBLE AS output, CASE WHEN digit = 1 THEN s * 3 ELSE n * 1.25 END::DOUBLE AS cache_create, CASE WHEN digit = 1 THEN s ELSE round(n * 0.1, 6) END::DOUBLE AS cache_read, NULL::DOUBLE AS input_above, 1.0::DOUBLE AS multiplier, CASE WHEN digit = 3 THEN s END AS context_limit FROM b")
def models_dev_prices(spark, d):
    """Models by their maker, prices for a million tokens."""
    one = F.col("digit") == 1
    cost = F.struct(F.col("n").alias("input"), F.col("s").alias("output"), F.when(one, F.col("s")).alias("cache_read"), F.when(one, F.col("s") * 3).alias("cache_write"))
    limit = F.when(F.col("digit") == 3, F.struct(F.col("s").alias("context")))
    makers = brands(spark, d).groupBy("mfgr").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(cost.alias("cost"), limit.alias("limit")).alias("e")))).alias("models"))
    return _rates(pricing.from_models_dev(spark, document(spark, makers, F.struct("models"), "mfgr")))


def _brand_prices(spark, d, **more: Column) -> DataFrame:
    return pricing.price_table(brands(spark, d).select("model", _per_token("n").alias("input"), _per_token("s").alias("output"), *[v.alias(k) for k, v in more.items()]))


@query(_BRANDS + "SELECT model, 'updated' AS change FROM b WHERE digit = 1 UNION ALL SELECT model, 'removed' FROM b WHERE digit = 2 UNION ALL SELECT 'new ' || model, 'added' FROM b WHERE digit = 3")
def price_changes(spark, d):
    old, digit = _brand_prices(spark, d), F.right("model", F.lit(1))
    new = old.where(digit != "2").withColumn("input", F.when(digit == "1", F.col("input") * 2).otherwise(F.col("input"))).unionByName(old.where(digit == "3").withColumn("model", F.concat(F.lit("new "), "model")))
    return pricing.price_changes(old, new)


@query(
    _BRANDS + """SELECT model, round(CASE WHEN digit IN (1, 2) THEN n * 2 ELSE n END, 4)::DOUBLE AS input, round(CASE WHEN digit = 1 THEN n * 2.5 ELSE n * 1.25 END, 4)::DOUBLE AS cache_create, round(CASE WHEN digit = 1 THEN n * 0.2 WHEN digit = 2 THEN s WHEN digit = 3 THEN 9 ELSE n * 0.1 END, 4)::DOUBLE AS cache_read, round(CASE WHEN digit = 1 THEN s * 6 WHEN digit = 2 THEN s * 3 ELSE s * 3 END, 4)::DOUBLE AS cache_create_above, digit IN (2, 3) AS explicit FROM b"""
)
def price_override_implied(spark, d):
    """A new input price scales cache prices that were only implied by the old one: brands of digit 1, but not 2, whose cache price was told; 3 gets a cache price of its own."""
    digit = F.right("model", F.lit(1))
    p = _brand_prices(spark, d, cache_read=F.when(F.right("model", F.lit(1)) == "2", _per_token("s")), cache_create_above=F.col("s") * 3 / 1e6)
    o = brands(spark, d).where(F.col("digit").isin(1, 2, 3)).select("model", F.when(F.col("digit") < 3, F.col("n") * 2 / 1e6).alias("input"), F.when(digit == "3", F.lit(9e-6)).alias("cache_read"))
    r = pricing.apply_overrides(p, o)
    return r.select("model", *[F.round(F.col(c) * 1e6, 4).alias(c) for c in ("input", "cache_create", "cache_read", "cache_create_above")], F.col("cache_read_explicit").alias("explicit"))


@query(
    _BRANDS + """SELECT coalesce(b.model, o.model) AS model, round(CASE WHEN o.digit = 1 THEN o.s WHEN o.digit = 4 THEN 7 ELSE b.n END, 4)::DOUBLE AS input, round(coalesce(b.s, 0), 4)::DOUBLE AS output, round(CASE WHEN o.digit = 1 THEN b.n * 1.25 * (o.s::DOUBLE / b.n) WHEN b.model IS NULL THEN 0 ELSE b.n * 1.25 END, 4)::DOUBLE AS cache_create, round(CASE WHEN o.digit = 1 THEN b.n * 0.1 * (o.s::DOUBLE / b.n) WHEN o.digit = 2 THEN 3 WHEN b.model IS NULL THEN 0 ELSE b.n * 0.1 END, 4)::DOUBLE AS cache_read
FROM (SELECT * FROM b WHERE digit <> 4) AS b FULL JOIN (SELECT * FROM b WHERE digit IN (1, 2, 4)) AS o ON b.model = o.model"""
)
def price_override(spark, d):
    """Overrides of brands of digit 1 (input), 2 (cache reads) and 4, which have no price before."""
    o = brands(spark, d).where(F.col("digit").isin(1, 2, 4)).select("model", F.when(F.col("digit") == 1, _per_token("s")).when(F.col("digit") == 4, F.lit(7e-6)).alias("input"), F.when(F.col("digit") == 2, F.lit(3e-6)).alias("cache_read"))
    p = _brand_prices(spark, d).where(F.right("model", F.lit(1)) != "4")
    return pricing.apply_overrides(p, o).select("model", *[F.round(F.col(c) * 1e6, 4).alias(c) for c in ("input", "output", "cache_create", "cache_read")])


@query(
    _BRANDS + """SELECT model, CASE WHEN digit % 2 = 1 THEN s ELSE n END::DOUBLE AS input, CASE WHEN digit % 2 = 1 THEN n ELSE s END::DOUBLE AS output, CASE WHEN digit % 2 = 1 THEN s * 1.25 ELSE n * 1.25 END::DOUBLE AS cache_create, round(CASE WHEN digit = 1 THEN n WHEN digit % 2 = 1 THEN s * 0.1 ELSE n * 0.1 END, 4)::DOUBLE AS cache_read, CASE WHEN digit IN (1, 2) THEN s END AS context_limit FROM b"""
)
def config_over_builtin(spark, d):
    """A config's prices (brands of odd digits) before a base table's (all brands); context limits are filled in."""
    entry = F.struct(F.struct(_per_token("s").alias("input"), _per_token("n").alias("output"), F.when(F.col("digit") == 1, _per_token("n")).alias("cacheRead")).alias("e"))["e"]
    config = pricing.from_config(spark, document(spark, brands(spark, d).where("digit % 2 = 1"), entry, within="pricing"))
    base = _brand_prices(spark, d, context_limit=F.when(F.col("digit").isin(1, 2), F.col("s")))
    return pricing.fill_missing(config, base).select("model", *[F.round(F.col(c) * 1e6, 4).alias(c) for c in ("input", "output", "cache_create", "cache_read")], "context_limit")


_BUILT_IN_MODELS = ["claude-sonnet-4", "gpt-5.5", "zai/glm-4.5-flash", "unlisted"]


@query("SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN input_tokens * 3e-6 + output_tokens * 15e-6 WHEN 1 THEN (input_tokens * 5e-6 + output_tokens * 30e-6) * 2.5 ELSE 0 END, 8) AS cost, event_id % 4 = 3 AS missing FROM e0")
def built_in_prices(spark, d):
    """Events priced by the built-in table."""
    u = events_usage(spark, d).withColumn("price_model", F.element_at(F.array(*map(F.lit, _BUILT_IN_MODELS)), (F.col("row_id") % 4 + 1).cast("int")))
    return pricing.price_usage(u, pricing.built_in(spark)).select(F.col("row_id").alias("event_id"), money("cost", 8).alias("cost"), F.col("missing_pricing_model").isNotNull().alias("missing"))


_FAST = [("gpt-5.5", 2.5), ("gpt-5.3-codex", 2.0), ("gpt-5.5-mini", 0.0), ("us/claude-opus-4.6:beta", 6.0), ("claude-opus-4-7-20260101", 6.0), ("claude-opus-4@8", 2.0), ("claude-opus-4-80", 0.0), ("x", 0.0)]


@query(f"SELECT event_id, t.m AS multiplier FROM events JOIN (VALUES {', '.join(f'({k}, {x})' for k, (_, x) in enumerate(_FAST))}) AS t(k, m) ON t.k = event_id % {len(_FAST)}")
def fast_multipliers(spark, d):
    return e0(spark, d).select("event_id", pricing.fast_multiplier(variant(len(_FAST), *[m for m, _ in _FAST])).alias("multiplier"))


# Dates, numbers and names.

_STAMPS = ["2024-03-10T23:30:00Z", "2024-03-10T23:30:00.25-05:00", "2024-03-10T23:30:00", "2024-03-10 23:30:00", "1710113400", "1710113400123", " 2024-03-10 x", "nonsense", ""]
_PARSED = ["2024-03-10 23:30:00", "2024-03-11 04:30:00.25", "2024-03-10 23:30:00", *[None] * 6]
_FLEXIBLE = [*_STAMPS[:4], "2024-03-10T23:30:00.000Z", "2024-03-10T23:30:00.123Z", "2024-03-10 x", None, None]


def _sql_text(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


@query(f"SELECT event_id, CAST(t.p AS TIMESTAMP) AS parsed, CASE WHEN event_id % 9 IN (0, 1) THEN CAST(t.p AS TIMESTAMP) END AS strict, t.f AS flexible FROM events JOIN (VALUES {', '.join(f'({k}, {_sql_text(p)}, {_sql_text(f)})' for k, (p, f) in enumerate(zip(_PARSED, _FLEXIBLE, strict=True)))}) AS t(k, p, f) ON t.k = event_id % 9")
def timestamp_texts(spark, d):
    t = variant(9, *_STAMPS)
    return e0(spark, d).select("event_id", dates.parse_timestamp(t).cast("timestamp_ntz").alias("parsed"), dates.parse_rfc3339(t).cast("timestamp_ntz").alias("strict"), dates.flexible_timestamp(t).alias("flexible"))


_DAYS = ["sunday", " Monday ", "TUESDAY", "wednesday", "thursday", "friday", "saturday", "someday", None]


@query("SELECT DISTINCT date, " + ", ".join(f"strftime(CAST(ts AS DATE) - CAST((dayofweek(ts) - {1 if k > 6 else k} + 7) % 7 AS INTEGER), '%Y-%m-%d') AS w{k}" for k in range(9)) + " FROM e0")
def week_starts(spark, d):
    date = F.date_format("ts", "yyyy-MM-dd")
    return e0(spark, d).select(date.alias("date"), *[dates.bucket(date, "weekly", name).alias(f"w{k}") for k, name in enumerate(_DAYS)]).distinct()


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS millis, date, CASE WHEN event_id % 2 = 0 THEN CAST(date AS DATE) END AS day,
make_timestamp(epoch_us(ts) // 1000 * 1000) AS back, strftime(CASE event_id % 3 WHEN 0 THEN (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' ELSE ts END, '%Y-%m-%d') AS zoned FROM e0"""
)
def time_formats(spark, d):
    """Times as texts and back: minutes, seconds, milliseconds, dates, epoch milliseconds, and zones by odd and unknown names."""
    zones = [dates.zone(n) for n in ("America/New York", "No/Where", "")]
    zoned = variant(3, *[dates.date_in_zone(F.col("ts"), z) for z in zones])
    day = dates.iso_date(F.when(F.col("event_id") % 2 == 0, dates.date_text(F.col("ts"))).otherwise(dates.minute_text(F.col("ts"))))
    return e0(spark, d).select("event_id", dates.minute_text(F.col("ts")).alias("minute"), dates.second_text(F.col("ts")).alias("second"), dates.millis_text(F.col("ts")).alias("millis"), dates.date_text(F.col("ts")).alias("date"), day.alias("day"), dates.from_millis(F.unix_millis("ts")).cast("timestamp_ntz").alias("back"), zoned.alias("zoned"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'undated' WHEN event_id % 3 = 1 THEN date[1:7] ELSE strftime(date_trunc('week', ts), '%Y-%m-%d') END AS period FROM e0")
def period_keys(spark, d):
    date = F.date_format("ts", "yyyy-MM-dd")
    return e0(spark, d).select("event_id", variant(3, dates.bucket(F.lit("undated"), "weekly"), dates.bucket(date, "monthly"), dates.bucket(date, "weekly")).alias("period"))


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' END AS span FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)")
def duration_long_texts(spark, d):
    return e0(spark, d).select("event_id", dates.duration_long(F.col("event_id") * 37 % 9000).alias("span"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN make_timestamp(event_id * 1000000 * 1000) END AS reset FROM events")
def usage_limit_resets(spark, d):
    line = variant(3, joined("x Claude AI usage limit reached, wait|", F.col("event_id") * 1000, '"}'), "Claude AI usage limit reached|soon", joined("limit|", F.col("event_id")))
    return e0(spark, d).select("event_id", text.usage_limit_reset(line).cast("timestamp_ntz").alias("reset"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * floor(event_id / 7.0 * 1e9) / 1e9 END AS cut FROM events")
def truncated_numbers(spark, d):
    v = F.col("event_id") / 7.0 * F.when(F.col("event_id") % 2 == 0, -1).otherwise(1)
    return e0(spark, d).select("event_id", text.truncate_9(variant(5, F.lit(None).cast("double"), F.lit(float("inf")), v, v, v)).alias("cut"))


@query("SELECT event_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size FROM (SELECT event_id, CAST(event_id AS BIGINT) * event_id * 512 AS n FROM events)")
def byte_sizes(spark, d):
    return e0(spark, d).select("event_id", text.byte_size(F.col("event_id") * F.col("event_id") * 512).alias("size"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN model WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS first FROM e0")
def first_filled_names(spark, d):
    first = text.first_filled(variant(4, joined("  ", F.col("model"), " "), "", None, " "), variant(4, "x", " b", "", None), variant(4, "y", "z", "c ", ""))
    return e0(spark, d).select("event_id", first.alias("first"))


@query("SELECT user_id, string_agg('- ' || m, chr(10) ORDER BY m) AS shown FROM (SELECT DISTINCT user_id, model AS m FROM e0) GROUP BY user_id")
def model_lists(spark, d):
    names = F.concat(F.array_agg(F.concat(F.lit("anthropic/"), "model")), F.array_agg("model"))
    return e0(spark, d).groupBy("user_id").agg(names.alias("names")).select("user_id", text.model_list(F.col("names")).alias("shown"))


@query("SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'Mine' WHEN 1 THEN 'Windows' ELSE 'p' || user_id END AS project FROM (SELECT DISTINCT user_id FROM events)")
def project_names(spark, d):
    aliases = text.parse_aliases("/a/b = Mine, c:/x=Windows,, broken")
    path = F.when(F.col("user_id") % 4 == 0, "/a/b").when(F.col("user_id") % 4 == 1, "c:\\x").when(F.col("user_id") % 4 == 2, joined("/home/q/p", F.col("user_id"))).otherwise(joined("c:\\q\\p", F.col("user_id")))
    return e0(spark, d).select("user_id").distinct().select("user_id", text.project_name(path, aliases).alias("project"))


@query("SELECT n.names[1 + event_id % len(n.names)] AS agent, count(*) AS records, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM e0, (SELECT ['amp', 'claude', 'codebuff', 'codex', 'copilot', 'droid', 'gemini', 'goose', 'hermes', 'kilo', 'kimi', 'openclaw', 'opencode', 'pi', 'qwen'] AS names) AS n GROUP BY 1")
def registered_sources(spark, d):
    """Events dealt to all registered sources, as the report of all agents sums them."""
    from tokentally.sources import all as sources

    names = [s.name for s in sources.get_all()]
    u = events_usage(spark, d).withColumn("agent", F.element_at(F.array(*map(F.lit, names)), (F.col("row_id") % len(names) + 1).cast("int")))
    return report.summarize(u, ["agent"], breakdown=False).select("agent", "records", "output_tokens")


@query("SELECT date, agent, count(*) AS records, CAST(sum(CASE WHEN date = '2024-01-10' THEN 2 ELSE 1 END * output_tokens) AS BIGINT) AS output_tokens FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS agent FROM e0) WHERE date BETWEEN '2024-01-08' AND '2024-01-12' AND (date <> '2024-01-10' OR agent = 'even' OR event_id % 4 = 1) GROUP BY ALL")
def usage_store(spark, d):
    """Records stored by date and agent; a second load of one day rewrites that day alone, and a report reads the days it asks for."""
    folder = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    u = events_usage(spark, d).withColumn("agent", F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd"))
    store.write_usage(u, folder)
    again = u.where("date = '2024-01-10' AND (agent = 'even' OR row_id % 4 = 1)").withColumn("output_tokens", F.col("output_tokens") * 2)
    store.write_usage(again, folder)
    return report.period_report(store.read_usage(spark, folder, "2024-01-08", "20240112"), by=("agent",), breakdown=False).select("date", "agent", "records", "output_tokens")


# Rendering.


@query(_GLOBAL + """, a AS (SELECT models, cost, tokens AS n, CAST((epoch_us((SELECT max(ts) FROM e) + INTERVAL 90 MINUTE) - epoch_us(block_start)) // 1000000 AS BIGINT) AS s FROM blk WHERE is_active)
SELECT concat_ws(' │ ', '⚡ ' || models, printf('$%.2f', cost), """ + _HUMAN + """, CASE WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' END) AS line FROM a""")
def statusline(spark, d):
    last = events_usage(spark, d).agg(F.max("ts").alias("t")).first().t
    return spark.createDataFrame([(render.statusline(global_blocks(spark, d), F.lit(last) + F.expr("INTERVAL 90 MINUTES")),)], "line string")


@query("SELECT date, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS records, string_agg(DISTINCT model, ',' ORDER BY model) AS models, false AS has_cost FROM e GROUP BY date")
def json_report(spark, d):
    """The report's JSON lines, without costs, read back."""
    lines = render.json_lines(report.period_report(events(spark, d)), no_cost=True)
    one = lines.select(F.from_json("value", "date string, input_tokens bigint, output_tokens bigint, records bigint, models_used array<string>").alias("r"), F.contains(F.lower("value"), F.lit("cost")).alias("has_cost"))
    return one.select("r.date", "r.input_tokens", "r.output_tokens", "r.records", F.array_join("r.models_used", ",").alias("models"), "has_cost")


@query(_GLOBAL + "SELECT block_start, tokens, is_active, CASE WHEN NOT is_active THEN block_end END AS actual_end FROM blk")
def blocks_json(spark, d):
    """The blocks' JSON lines read back."""
    lines = render.json_lines(blocks.projection(blocks.burn_rate(global_blocks(spark, d)), 5000))
    j = lines.select(F.from_json("value", "block_start timestamp, actual_end timestamp, tokens bigint, is_active boolean").alias("r"))
    return j.select(F.col("r.block_start").cast("timestamp_ntz").alias("block_start"), "r.tokens", "r.is_active", F.col("r.actual_end").cast("timestamp_ntz").alias("actual_end"))


@query("SELECT strftime(date_trunc('month', CASE WHEN event_id % 6 = 1 THEN ts + INTERVAL 5 HOUR ELSE ts END), '%Y-%m') AS date, 'amp' AS agent, CAST(sum(input_tokens + 1 + output_tokens) AS BIGINT) AS total_tokens, count(*) AS records FROM e0 WHERE event_id % 6 NOT IN (2, 3) GROUP BY 1 UNION ALL SELECT date[1:7], 'codex', CAST(sum(input_tokens + 2 * output_tokens + 1) AS BIGINT), count(*) FROM e0 WHERE event_id % 11 <> 0 GROUP BY 1")
def agents_monthly(spark, d):
    """Records of two agents' parsers in one report."""
    frames = [pricing.price_usage(_generic(spark, d), prices(spark), "logged"), codex.to_usage(_codex_events(spark, d), prices(spark))]
    return report.all_agents(frames, "monthly", breakdown=False).select("date", "agent", "total_tokens", "records")



