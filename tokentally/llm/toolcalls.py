"""Operator 3: tool-call linking, by DataFrame operations alone.

Messages are rows (conv_id, turn, role, text).  An assistant's text may be a JSON
object with ``tool_calls``: a list of {id, name, arguments, depends_on}; a tool's
text may be {tool_call_id, content}.  Calls and results are hash-joined by
(conv_id, identifier), calls are ordered topologically by their dependencies,
arguments are checked against the tools' schemas, and each call is written as
canonical JSON (keys sorted, no white space).  Nothing is collected by conversation,
so a conversation of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.shared import materialize, table

CALLS = "tool_calls array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>"
RESULT = "tool_call_id string, content string"
FIRST = -(2**63)  # the place of a null turn
IDS = ["conv_id", "call_id"]
#: Ids that more rows than this name are put in order by several tasks.
LARGEST_GROUP = 100_000


def parse_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_no, call_id, name, arguments (JSON text), depends_on of every call.

    Null conversations or texts and texts that aren't such JSON hold no call.  Equal messages count
    once; calls that share a conversation and id are all kept.
    """
    held = messages.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("text").contains("tool_calls")).select("conv_id", "turn", "text").distinct()
    one = held.select("conv_id", "turn", F.posexplode(F.from_json("text", CALLS)["tool_calls"]).alias("call_no", "c"))
    return one.select("conv_id", "turn", "call_no", F.col("c.id").alias("call_id"), "c.name", F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))


def parse_results(messages: DataFrame) -> DataFrame:
    """conv_id, call_id, result_turn, result of every result; equal messages count once."""
    held = messages.where((F.col("role") == "tool") & F.col("conv_id").isNotNull() & F.col("text").contains("tool_call_id")).select("conv_id", "turn", "text").distinct()
    one = held.select("conv_id", "turn", F.from_json("text", RESULT).alias("r")).where("r.tool_call_id IS NOT NULL")
    return one.select("conv_id", F.col("r.tool_call_id").alias("call_id"), F.col("turn").alias("result_turn"), F.col("r.content").alias("result"))


def _hot(calls: DataFrame, results: DataFrame, largest: int) -> DataFrame | None:
    """conv_id, call_id of the ids that more than ``largest`` calls, results and dependencies name together; None if there are none."""
    asked = calls.select("conv_id", F.explode(F.array_distinct("depends_on")).alias("call_id"))
    every = calls.select(*IDS).unionByName(results.select(*IDS)).unionByName(asked).where("call_id IS NOT NULL")
    hot = materialize(every.groupBy(*IDS).agg(F.count("*").alias("n")).where(F.col("n") > largest).select(*IDS), "hot")
    return None if hot.isEmpty() else hot


def _cut(rows: DataFrame, hot: DataFrame | None, order: list[str]) -> DataFrame:
    """``rows`` with part: -1, but for the ids of ``hot``, whose rows are cut into ranges of ``order`` (numbered along it), so that no task orders all rows of one id."""
    if hot is None:
        return rows.withColumn("part", F.lit(-1))
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = rows.join(hot, IDS, "left_semi").repartitionByRange(ranges, *IDS, *order).withColumn("part", F.spark_partition_id())
    return rows.join(hot, IDS, "left_anti").withColumn("part", F.lit(-1)).unionByName(materialize(many, "ranges"))


def _ranked(rows: DataFrame, keys: list[str], order: list[str], hot: DataFrame | None, name: str, whole: str | None = None) -> DataFrame:
    """``rows`` of _cut() with their number among those of ``keys`` and, as ``whole``, how many these are.

    A group that lies in several ranges goes on counting where the range before ends; the
    sums that this takes have a row for each range of a group.
    """
    by_key = Window.partitionBy(*keys, "part")
    rows = rows.withColumn(name, F.row_number().over(by_key.orderBy(*order)).cast("long"))
    rows = rows.withColumn(whole, F.count("*").over(by_key)) if whole else rows
    if hot is None:
        return rows
    by_range = Window.partitionBy(*keys)
    sums = rows.where("part >= 0").groupBy(*keys, "part").agg(F.count("*").alias("n"))
    sums = sums.select(*keys, "part", F.sum("n").over(by_range.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("n").over(by_range).alias("all"))
    rows = rows.join(sums, [*keys, "part"], "left").withColumn(name, F.col(name) + F.coalesce("before", F.lit(0)))
    return (rows.withColumn(whole, F.coalesce("all", whole)) if whole else rows).drop("before", "all")


def _numbered(calls: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``calls`` with occurrence, their number among the calls of their id, i, that within the turn, and times, how many calls have the id; a call without an id is alone."""
    order = ["of", "call_no", "name", "digest", "node"]
    one = F.lit(1).cast("long")
    named = _ranked(_cut(calls.where("call_id IS NOT NULL"), hot, order), IDS, order, hot, "occurrence", "times")
    named = _ranked(named, [*IDS, "of"], order[1:], hot, "i").drop("part")
    return named.unionByName(calls.where("call_id IS NULL").withColumns({"occurrence": one, "i": one, "times": one}))


def _placed(results: DataFrame, calls: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``results`` with of, the turn whose calls they answer, and i, their number among its results.

    That is the last turn up to the result's own with a call of the id, or the id's first one; null for an id without calls.
    """
    places = calls.where("call_id IS NOT NULL").select(*IDS, F.col("of").alias("t"), F.lit(0).alias("kind")).distinct()
    both = results.withColumn("t", F.coalesce("result_turn", F.lit(FIRST))).withColumn("kind", F.lit(1)).unionByName(places, allowMissingColumns=True)
    both = _cut(both, hot, ["t", "kind", "head", "digest", "answer"])
    by_id = Window.partitionBy(*IDS, "part")
    turn = F.when(F.col("kind") == 0, F.col("t"))
    last, first = F.last(turn, ignorenulls=True).over(by_id.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.min(turn).over(by_id)
    if hot is None:
        both = both.withColumn("of", F.coalesce(last, first))
    else:
        by_range = Window.partitionBy(*IDS)
        ends = both.where("part >= 0").groupBy(*IDS, "part").agg(F.max(turn).alias("top"), F.min(turn).alias("low"))
        ends = ends.select(*IDS, "part", F.max("top").over(by_range.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.min("low").over(by_range).alias("lowest"))
        both = both.withColumn("last", last).withColumn("first", first).join(ends, [*IDS, "part"], "left").withColumn("of", F.coalesce("last", "carried", "lowest", "first")).drop("last", "first", "carried", "lowest")
    return _ranked(both.where("kind = 1"), [*IDS, "of"], ["t", "head", "digest", "answer"], hot, "i").drop("t", "kind", "part")


def _graph(calls: DataFrame, hot: DataFrame | None) -> DataFrame:
    """conv_id, call_id, depends_on in terms of node: a repeated id stands for its last call before the one that depends on it, or else its first.

    ``calls`` are those of _numbered().  Calls without an id are in it too: nothing can depend on
    them, but they may depend on others.  Ids that one call has are found by a
    join, which can be split where many calls need one; only repeated ids are put in order.
    """
    provided = calls.where("call_id IS NOT NULL").select(*IDS, "times", "of", "call_no", "node")
    asked = calls.where("size(depends_on) > 0").select("conv_id", F.explode(F.array_distinct("depends_on")).alias("call_id"), "of", "call_no", "node").where("call_id IS NOT NULL")
    single = asked.select(*IDS, "node").join(provided.where("times = 1").select(*IDS, F.col("node").alias("needed")), IDS).select("node", "needed")
    again = provided.where("times > 1").drop("times").withColumn("kind", F.lit(1))
    both = asked.join(again.select(*IDS).distinct(), IDS, "left_semi").withColumn("kind", F.lit(0)).unionByName(again)
    both = _cut(both, hot, ["of", "call_no", "kind", "node"])
    order = Window.partitionBy(*IDS, "part").orderBy("of", "call_no", "kind", "node")
    node = F.when(F.col("kind") == 1, F.col("node"))
    whole, before = (order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, Window.currentRow))
    last, first = F.last(node, ignorenulls=True).over(before), F.first(node, ignorenulls=True).over(whole)
    if hot is None:
        both = both.withColumn("needed", F.coalesce(last, first))
    else:
        by_range, place = Window.partitionBy(*IDS), F.when(F.col("kind") == 1, F.struct("of", "call_no", "node"))
        ends = both.where("part >= 0").groupBy(*IDS, "part").agg(F.max(place).alias("top"), F.min(place).alias("low"))
        ends = ends.select(*IDS, "part", F.max("top").over(by_range.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))["node"].alias("carried"), F.min("low").over(by_range)["node"].alias("lowest"))
        both = both.withColumn("last", last).withColumn("first", first).join(ends, [*IDS, "part"], "left").withColumn("needed", F.coalesce("last", "carried", "lowest", "first"))
    needs = single.unionByName(both.where("kind = 0").select("node", "needed")).groupBy("node").agg(F.collect_set(F.col("needed").cast("string")).alias("needs"))  # no longer than the call's own list
    return calls.select("conv_id", "node").join(needs, "node", "left").select("conv_id", F.col("node").cast("string").alias("call_id"), F.coalesce("needs", F.array().cast("array<string>")).alias("depends_on"))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: the longest chain of calls that a call depends on.

    Dependencies on calls that don't exist count for nothing; calls on a cycle, or
    behind one, have a null level.  Calls without dependencies have level 0 and
    take part in no round.  A call with one dependency looks through chains of
    such calls by doubling, so chains of thousands take a dozen rounds.  Only
    joints, calls with several dependencies, are resolved one after the other:
    there are as many rounds as the longest path has joints.
    """
    keys = ["conv_id", "call_id"]
    known = calls.where("call_id IS NOT NULL").select(*keys)
    needs = calls.where("call_id IS NOT NULL AND size(depends_on) > 0").select(*keys, F.explode(F.array_distinct("depends_on")).alias("needed"))
    needs = needs.join(known.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"], "left_semi")
    needs = materialize(needs.withColumn("n", F.count("*").over(Window.partitionBy(*keys))), "needs")
    roots = known.join(needs.select(*keys), keys, "left_anti").withColumn("level", F.lit(0))
    if needs.isEmpty():
        return roots
    chained = _anchored(needs.where("n = 1").drop("n"))  # call_id -> (anchor, more); a null anchor for what is on or behind a cycle of such calls
    joints = needs.where("n > 1").drop("n")
    if joints.isEmpty():
        return roots.unionByName(chained.select(*keys, F.when(F.col("anchor").isNotNull(), F.col("more")).alias("level")))
    resolved = _joints(joints, chained, roots)
    far = chained.join(resolved.unionByName(roots).withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"], "left")
    cyclic = joints.select(*keys).distinct().join(resolved, keys, "left_anti").withColumn("level", F.lit(None).cast("int"))
    return roots.unionByName(resolved).unionByName(cyclic).unionByName(far.select(*keys, (F.col("level") + F.col("more")).alias("level")))


def _anchored(needs: DataFrame) -> DataFrame:
    """conv_id, call_id, anchor, more: for calls with one dependency the first call up the chain that has none or several, and how many steps away it is.

    Each round every call jumps to where the call that it points at points, twice
    as far.  After as many rounds as the number of calls has binary digits,
    whoever still points at such a call is on a cycle or behind one: its anchor is null.
    """
    keys = ["conv_id", "call_id"]
    left = materialize(needs.select(*keys, F.col("needed").alias("anchor"), F.lit(1).alias("more")), "chains")
    done = left.limit(0)
    for _ in range(left.count().bit_length() + 1):
        up = left.unionByName(done).select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("more").alias("further"))
        jumped = materialize(left.join(up, ["conv_id", "anchor"], "left"), "chains")
        done = done.unionByName(jumped.where("next IS NULL").select(*keys, "anchor", "more"))
        left = jumped.where("next IS NOT NULL").select(*keys, F.col("next").alias("anchor"), (F.col("more") + F.col("further")).alias("more"))
        if left.isEmpty():
            return done
    return done.unionByName(left.select(*keys, F.lit(None).cast("string").alias("anchor"), "more"))


def _joints(needs: DataFrame, chained: DataFrame, roots: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls with several dependencies that are on no cycle and behind none."""
    keys = ["conv_id", "call_id"]
    through = chained.select("conv_id", F.col("call_id").alias("needed"), F.lit(True).alias("chain"), "anchor", "more")
    edges = needs.join(through, ["conv_id", "needed"], "left").select(*keys, F.when(F.col("chain"), F.col("anchor")).otherwise(F.col("needed")).alias("needed"), F.coalesce("more", F.lit(0)).alias("more"))
    ready = roots.join(edges.select("conv_id", F.col("needed").alias("call_id")).distinct(), keys, "left_semi")
    edges, out = materialize(edges.withColumn("level", F.lit(None).cast("int")), "joints"), None
    while True:
        got = ready.select("conv_id", F.col("call_id").alias("needed"), F.col("level").alias("new"))
        edges = materialize(edges.join(got, ["conv_id", "needed"], "left").select(*keys, "needed", "more", F.coalesce("level", F.col("new") + F.col("more")).alias("level")), "joints")
        ready = materialize(edges.groupBy(*keys).agg(F.max("level").alias("level"), F.count("*").alias("n"), F.count("level").alias("told")).where("n = told").select(*keys, (F.col("level") + 1).alias("level")), "ready")
        out = ready if out is None else out.unionByName(ready)
        if ready.isEmpty():
            return out
        edges = edges.join(ready.select(*keys), keys, "left_anti")


def json_type(value) -> F.Column:
    """The JSON type of a VARIANT."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BIGINT", "integer").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("number")
    )


def with_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with value, their arguments as VARIANT (null if they are no JSON), and errors: what breaks their tool's schema (schemas: name, property, type, required).

    Errors are sorted and joined by ``;``: ``tool`` (unknown), ``json`` (arguments are no object, or repeat a name),
    ``missing:p``, ``type:p`` and ``unknown:p``.  An integer is also a number.  Each call is
    checked by itself, with its tool's properties as one array.
    """
    tools = schemas.groupBy("name").agg(F.collect_set(F.when(F.col("property").isNotNull(), F.struct("property", "type", "required"))).alias("wanted"))
    own = calls.withColumn("value", F.try_parse_json("arguments"))
    given = F.when(json_type(F.col("value")) == "object", F.transform_values(F.from_json("arguments", "map<string, variant>"), lambda _, v: json_type(v)))
    own = own.withColumn("given", given).join(tools, "name", "left")

    def breaks(p: F.Column) -> F.Column:
        kind = F.try_element_at("given", p["property"])
        fits = (kind == p["type"]) | ((kind == "integer") & (p["type"] == "number"))
        return F.when(kind.isNull(), F.when(p["required"], F.concat(F.lit("missing:"), p["property"]))).when(~fits, F.concat(F.lit("type:"), p["property"]))

    unknown = F.transform(F.filter(F.map_keys("given"), lambda k: ~F.exists("wanted", lambda p: p["property"] == k)), lambda k: F.concat(F.lit("unknown:"), k))
    broken = F.filter(F.transform("wanted", breaks), lambda e: e.isNotNull())
    found = F.array_join(F.array_sort(F.concat(unknown, broken)), ";")
    return own.withColumn("errors", F.when(F.col("wanted").isNull(), "tool").when(F.col("given").isNull(), "json").otherwise(found)).drop("given", "wanted")


def link_all(messages: DataFrame, schemas: DataFrame, largest: int = LARGEST_GROUP) -> DataFrame:
    """One row for each call and each result without one: conv_id, turn, call_no, call_id, name, level, valid, errors, result_turn, result, record, occurrence.

    (level, turn, call_no) orders a conversation's calls topologically; calls on a cycle
    have no level.  record is canonical JSON.  Calls without a result have nulls
    there.  A repeated id is linked by turns: a result belongs to the last turn up to its own
    that calls the id (else the first such turn), the i-th result (by turn, then by text) to its i-th call;
    occurrence numbers the calls of an id.  Results left over have rows without
    turn, call_no, name and occurrence, and the error ``duplicate``, or ``orphan`` if nothing calls
    their id.  Extra columns are ignored, equal messages count once, and no messages give no rows.
    A null turn comes first; calls of different messages are different calls, though their
    conversation, turn and id be the same; a call without an id has errors and a
    level of its own and no result.  Texts of any length are handled row by row.

    Ids, turns and dependencies are worked out on rows without texts; arguments and results join in at the end.
    An id that more than ``largest`` rows of one conversation name is ordered in ranges, with the same result.
    """
    parsed = with_errors(parse_calls(messages), schemas)
    calls = materialize(parsed.withColumn("digest", F.xxhash64("arguments")).withColumn("node", F.monotonically_increasing_id()).withColumn("of", F.coalesce("turn", F.lit(FIRST))), "calls")
    results = materialize(parse_results(messages).withColumn("answer", F.monotonically_increasing_id()), "results")
    light = calls.select("conv_id", "call_id", "of", "call_no", "name", "digest", "node", "depends_on")
    hot = _hot(light, results, largest)
    numbered = materialize(_numbered(light, hot).drop("name", "digest"), "numbered")
    level = levels(_graph(numbered, hot)).select(F.col("call_id").cast("long").alias("node"), "level")
    numbered = numbered.select("conv_id", "call_id", "of", "i", "node", "occurrence").join(level, "node", "left")
    placed = _placed(results.select("conv_id", "call_id", "result_turn", F.substring("result", 1, 64).alias("head"), F.xxhash64("result").alias("digest"), "answer"), light, hot).drop("result_turn", "head", "digest")
    linked = materialize(numbered.join(placed, ["conv_id", "call_id", "of", "i"], "full_outer").select("node", "answer", "level", "occurrence", F.when(F.col("of").isNull(), "orphan").otherwise("duplicate").alias("alone")), "linked")
    texts = results.select("answer", "result_turn", "result")
    found = calls.join(linked.where("node IS NOT NULL").drop("alone"), "node").join(texts, "answer", "left")
    lone = results.join(linked.where("node IS NULL").select("answer", F.col("alone").alias("errors")), "answer")
    rows = found.select("conv_id", "turn", "call_no", "call_id", "name", "level", "errors", "result_turn", "result", "occurrence", "arguments", "value")
    rows = rows.unionByName(lone.select("conv_id", "call_id", "errors", "result_turn", "result"), allowMissingColumns=True)
    arguments = F.when(F.col("call_no").isNotNull(), F.coalesce("value", F.to_variant_object(F.struct(F.col("arguments").alias("text")))))
    record = F.to_json(F.struct(arguments.alias("arguments"), F.col("conv_id"), F.col("errors"), F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.col("result"), F.col("turn")), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "turn", "call_no", "call_id", "name", "level", (F.col("errors") == "").alias("valid"), "errors", "result_turn", "result", record.alias("record"), "occurrence")


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """link_all() without its last column, of the calls without an id and each id's first one alone; link_all() has the others and the results left over."""
    return link_all(messages, schemas).where("call_no IS NOT NULL AND (call_id IS NULL OR occurrence = 1)").drop("occurrence")


#: Tools of the registered query: name, property, type, required.
QUERY_SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", True), ("lookup", "key", "string", True), ("lookup", "exact", "boolean", True), ("summarise", "text", "string", True), ("summarise", "ratio", "number", False)]


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain turns as tool messages, since the table holds none: an assistant's turn t becomes the call ``ct`` (from turn 3 on it depends on the call two turns before), a user's turn t the result of the call ``c(t-1)``.

    The number of words picks the tool, and some calls break their schema.  A null text is no message; an
    assistant's null turn is a call without an id, a user's one no result.
    """
    n = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    base = conversations.select("conv_id", "turn", "role", "text", n.alias("n")).where("text IS NOT NULL")
    pick = lambda m, k: F.col("n") % m == k
    arguments = (
        F.when(pick(3, 0), F.when(pick(7, 0), F.to_json(F.struct(F.col("text").alias("query"), F.col("n").cast("string").alias("limit")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), F.col("n").alias("limit")))))
        .when(pick(3, 1), F.when(pick(5, 0), F.to_json(F.struct(F.col("text").alias("key")))).otherwise(F.to_json(F.struct(F.col("text").alias("key"), (F.col("n") % 2 == 0).alias("exact")))))
        .otherwise(F.when(pick(11, 0), F.to_json(F.struct(F.col("text").alias("text"), F.lit("xx").alias("lang"), F.lit(0.5).alias("ratio")))).otherwise(F.to_json(F.struct(F.col("text").alias("text"), F.lit(0.5).alias("ratio")))))
    )
    name = F.when(pick(3, 0), "search").when(pick(3, 1), "lookup").otherwise("summarise")
    quoted = lambda c: F.coalesce(F.concat(F.lit('"c'), c.cast("string"), F.lit('"')), F.lit("null"))
    needs = F.when(F.col("turn") >= 3, quoted(F.col("turn") - 2)).otherwise("")
    call = F.concat(F.lit('{"tool_calls":[{"id":'), quoted(F.col("turn")), F.lit(',"name":"'), name, F.lit('","depends_on":['), needs, F.lit('],"arguments":'), arguments, F.lit("}]}"))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", result)
    return base.select("conv_id", "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def tool_calls_query(spark, sf_dir: str) -> DataFrame:
    """Every call of the table with its result, and every result without a call."""
    schemas = spark.createDataFrame(QUERY_SCHEMAS, "name string, property string, type string, required boolean")
    return link_all(as_tool_messages(table(spark, sf_dir, "conversations")), schemas).drop("occurrence")


SQL = r"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, role, text, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL),
c AS (
  SELECT conv_id, turn, 'c' || turn AS call_id,
    CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'summarise' END AS name,
    CASE WHEN n % 3 = 0 AND n % 7 = 0 THEN json_object('limit', CAST(n AS VARCHAR), 'query', text)
         WHEN n % 3 = 0 THEN json_object('limit', n, 'query', text)
         WHEN n % 3 = 1 AND n % 5 = 0 THEN json_object('key', text)
         WHEN n % 3 = 1 THEN json_object('exact', n % 2 = 0, 'key', text)
         WHEN n % 11 = 0 THEN json_object('lang', 'xx', 'ratio', 0.5::DOUBLE, 'text', text)
         ELSE json_object('ratio', 0.5::DOUBLE, 'text', text) END AS arguments,
    CASE WHEN n % 3 = 0 AND n % 7 = 0 THEN 'type:limit' WHEN n % 3 = 1 AND n % 5 = 0 THEN 'missing:exact' WHEN n % 3 = 2 AND n % 11 = 0 THEN 'unknown:lang' ELSE '' END AS errors
  FROM b WHERE role = 'assistant'),
l AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM c LEFT JOIN c AS d ON c.conv_id = d.conv_id AND d.turn = c.turn - 2 AND c.turn >= 3 WHERE d.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2 AND c.turn >= 3),
r AS (SELECT conv_id, turn AS result_turn, text AS result FROM b WHERE role = 'user')
SELECT c.conv_id, c.turn, 0 AS call_no, c.call_id, c.name, l.level, c.errors = '' AS valid, c.errors, r.result_turn, r.result,
  CAST(json_object('arguments', c.arguments, 'conv_id', c.conv_id, 'errors', c.errors, 'id', c.call_id, 'level', l.level, 'name', c.name, 'result', r.result, 'turn', c.turn) AS VARCHAR) AS record
FROM c JOIN (SELECT DISTINCT conv_id, turn, level FROM l) AS l ON c.conv_id = l.conv_id AND c.turn IS NOT DISTINCT FROM l.turn LEFT JOIN r ON r.conv_id = c.conv_id AND r.result_turn = c.turn + 1
UNION ALL
SELECT r.conv_id, NULL, NULL, 'c' || (r.result_turn - 1), NULL, NULL, false, 'orphan', r.result_turn, r.result,
  CAST(json_object('arguments', NULL, 'conv_id', r.conv_id, 'errors', 'orphan', 'id', 'c' || (r.result_turn - 1), 'level', NULL, 'name', NULL, 'result', r.result, 'turn', NULL) AS VARCHAR)
FROM r LEFT JOIN c ON r.conv_id = c.conv_id AND r.result_turn = c.turn + 1 WHERE c.conv_id IS NULL AND r.result_turn IS NOT NULL
"""
