"""Registered raw-record extractors, label maps and file sources, each over a whole table, with DuckDB oracles.

The stand-in inputs give the tables' rows the schema the operators expect
(instructions, marked-up chats, transcripts, saved states); all extracting is
done by the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import keywords as KW
from ..functions import text as X
from ..operators import anomaly as AN
from ..operators import corpus as C
from ..sources import files as FL
from ..sources import states as ST
from ..sources.tables import activity_log, read_table
from ..streaming.user_state import _scratch
from . import params as P
from . import sql_text as S
from .anomaly_queries import _features_sql
from .registry import register


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


_TEXT = S.py_strip("coalesce(text, '')")


@register("extract_qa_projection", f"""
    SELECT doc_id, {S.py_strip("coalesce(source, '')")} AS "user", {_TEXT} AS assistant FROM documents
    WHERE length({S.py_strip("coalesce(source, '')")}) > 0 AND length({_TEXT}) > 300""")
def q_qa(spark, sf):
    """B1/B3."""
    return C.qa_projection(_docs(spark, sf).select("doc_id", "source", "text"), "source", "text", 300).select("doc_id", "user", "assistant")


@register("extract_field_fallback", f"""
    SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND {S.py_strip("coalesce(lang, '')")} <> '' THEN {S.py_strip("coalesce(lang, '')")}
      WHEN doc_id % 5 <> 0 AND {S.py_strip("coalesce(source, '')")} <> '' THEN {S.py_strip("coalesce(source, '')")}
      ELSE {_TEXT} END AS answer FROM documents""")
def q_fallback(spark, sf):
    """B2: the first of three fields that is not blank; every third has a null, every fifth a blank one."""
    a = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    b = F.when(F.col("doc_id") % 5 != 0, F.col("source")).otherwise("  ")
    return _docs(spark, sf).select("doc_id", X.first_nonempty(a, b, F.col("text")).alias("answer"))


@register("extract_instruction_merge", f"""
    SELECT doc_id, {S.py_strip("coalesce(source, '')")} || CASE WHEN doc_id % 2 = 0 AND {_TEXT} <> '' THEN chr(10) || {_TEXT} ELSE '' END AS "user"
    FROM documents""")
def q_merge(spark, sf):
    """The input is missing in every second row."""
    return _docs(spark, sf).select("doc_id", X.merge_instruction(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("text"))).alias("user"))


def _marked_up(spark, sf):
    t = F.concat(
        F.lit("<s>[INST] "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<<SYS>> "), F.col("lang"), F.lit(" <</SYS>> "))).otherwise(""),
        F.col("source"), F.when(F.col("doc_id") % 7 != 0, " [/INST] ").otherwise(" "), F.col("text"), F.lit(" </s>"),
    )
    return _docs(spark, sf).select("doc_id", t.alias("raw"))


@register("extract_chat_markup", f"""
    SELECT doc_id, {S.py_strip("coalesce(source, '')")} AS question, {S.py_strip("replace(text, '</s>', '')")} AS answer
    FROM documents WHERE doc_id % 7 <> 0""")
def q_markup(spark, sf):
    """B5 over marked-up chats; every seventh lacks the closing marker and is dropped."""
    q, a = X.split_chat_markup("raw")
    return _marked_up(spark, sf).select("doc_id", q.alias("question"), a.alias("answer")).where("question IS NOT NULL")


def _transcripts(spark, sf):
    """A conversation's turns joined by the end marker; assistants are teachers and say a tag first."""
    who = F.when(F.col("role") == "assistant", "Teacher: (generic)").otherwise(F.concat(F.initcap("role"), F.lit(": ")))
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", F.concat(who, F.coalesce("text", F.lit(""))).alias("said"))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]), X.EOM).alias("transcript"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("problem "), F.col("conv_id").cast("string"))).alias("problem"),
    )


@register("extract_transcript_pairs", f"""
    WITH t AS (SELECT conv_id, turn, role, {_TEXT} AS body, row_number() OVER w - 1 AS pos, lead(role) OVER w AS next_role,
                      {S.py_strip("coalesce(lead(text) OVER w, '')")} AS next_body FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, CAST(pos AS INTEGER) AS turn_pos,
           CASE WHEN pos = 0 AND conv_id % 2 = 0 THEN {S.q(X.MATH_PREFIX)} || 'problem ' || conv_id || chr(10) || chr(10) || 'Student: ' || body ELSE body END AS "user",
           next_body AS assistant
    FROM t WHERE role <> 'assistant' AND next_role = 'assistant' AND body <> '' AND next_body <> ''""")
def q_transcripts(spark, sf):
    """B10."""
    return C.transcript_pairs(_transcripts(spark, sf), "conv_id", "transcript", "problem")


@register("extract_problem_solution", f"""
    SELECT doc_id, {S.q(X.SOLVE_Q)} || {S.py_strip("coalesce(source, '')")} AS "user",
           'Sure! Let me walk you through this step by step.' || chr(10) || chr(10) || {_TEXT} AS assistant
    FROM documents WHERE {S.py_strip("coalesce(source, '')")} <> '' AND {_TEXT} <> ''""")
def q_problem(spark, sf):
    """B11."""
    return C.problem_solution_pair(_docs(spark, sf).select("doc_id", "source", "text"), "source", "text").select("doc_id", "user", "assistant")


@register("extract_last_exchange", f"""
    WITH last_a AS (SELECT conv_id, max(turn) AS ta FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    last_u AS (SELECT c.conv_id, max(c.turn) AS tu FROM conversations c JOIN last_a a ON a.conv_id = c.conv_id AND c.turn < a.ta
               WHERE c.role <> 'assistant' GROUP BY c.conv_id)
    SELECT u.conv_id, {S.py_strip("string_split(" + S.py_strip("cu.text") + ", chr(10))[1]")} AS "user", {S.py_strip("ca.text")} AS assistant
    FROM last_u u JOIN last_a a USING (conv_id) JOIN conversations cu ON cu.conv_id = u.conv_id AND cu.turn = u.tu
    JOIN conversations ca ON ca.conv_id = u.conv_id AND ca.turn = a.ta
    WHERE {S.py_strip("string_split(" + S.py_strip("cu.text") + ", chr(10))[1]")} <> '' AND length({S.py_strip("ca.text")}) > 20
      AND NOT EXISTS (SELECT 1 FROM conversations z WHERE z.conv_id = u.conv_id AND z.turn > a.ta)""")
def q_last_exchange(spark, sf):
    """A conversation as one blob; conversations that do not end with the agent are no sales dialogues."""
    c = read_table(spark, sf, "conversations")
    who = F.when(F.col("role") == "assistant", X.AGENT_MARK).otherwise(X.CUSTOMER_MARK)
    said = F.struct("turn", F.concat(who, F.lit(" "), F.coalesce("text", F.lit(""))).alias("said"))
    blob = c.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n").alias("blob"), F.max_by("role", "turn").alias("end")
    )
    return C.last_exchange(blob.where("end = 'assistant'"), "conv_id", "blob")


@register("extract_bio", f"""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR {_TEXT} = '' THEN '{P.SYSTEM_TEXT}' ELSE '{P.SYSTEM_TEXT} Speak in the style of this character: ' || {_TEXT} END AS system
    FROM documents""")
def q_bio(spark, sf):
    """Every third row has no biography."""
    return _docs(spark, sf).select("doc_id", C.append_bio(F.lit(P.SYSTEM_TEXT), F.when(F.col("doc_id") % 3 != 0, F.col("text"))).alias("system"))


_EMOTIONS = [e for e, _ in KW.EMOTION_TO_CLASS] + ["boredom"]
_SETS = [*KW.GO_STRUGGLING, *KW.GO_MOTIVATED, "curiosity", "realization"]
_TAGS = [*KW.MOTIVATED_TAGS, *KW.STRUGGLING_TAGS, "Self-Doubt", "humor"]


def _pick(values: list[str], k: str = "doc_id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(k), F.lit(len(values))) + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(S.q(v) for v in values) + "]"


def _sql_pick(values: list[str], k: str) -> str:
    return f"{_sql_list(values)}[CAST(({k}) % {len(values)} AS INTEGER) + 1]"


_CASE7 = " ".join(f"WHEN {S.q(a)} THEN {S.q(b)}" for a, b in KW.EMOTION_TO_CLASS)


@register("labels_single_emotion", f"SELECT doc_id, CASE {_sql_pick(_EMOTIONS, 'doc_id')} {_CASE7} ELSE 'neutral' END AS label FROM documents")
def q_d7(spark, sf):
    """D7."""
    return _docs(spark, sf).select("doc_id", KW.emotion_to_class(_pick(_EMOTIONS)).alias("label"))


@register("labels_emotion_set", f"""
    SELECT doc_id, CASE WHEN len(list_filter([{_sql_pick(_SETS, 'doc_id')}, {_sql_pick(_SETS, 'n_chars')}], lambda x: list_contains({_sql_list(KW.GO_STRUGGLING)}, x))) > 0 THEN 'struggling'
      WHEN len(list_filter([{_sql_pick(_SETS, 'doc_id')}, {_sql_pick(_SETS, 'n_chars')}], lambda x: list_contains({_sql_list(KW.GO_MOTIVATED)}, x))) > 0 THEN 'motivated' ELSE 'neutral' END AS label
    FROM documents""")
def q_d8(spark, sf):
    """Two emotions a row."""
    return _docs(spark, sf).select("doc_id", KW.emotion_set_to_class(F.array(_pick(_SETS), _pick(_SETS, "n_chars"))).alias("label"))


@register("labels_tags", f"""
    WITH t AS (SELECT doc_id, [upper({_sql_pick(_TAGS, 'doc_id')}), {_sql_pick(_TAGS, 'n_chars')}] AS tags FROM documents),
    l AS (SELECT doc_id, list_transform(tags, lambda x: replace(lower(x), '-', ' ')) AS tags FROM t)
    SELECT doc_id, CASE WHEN len(list_filter(tags, lambda x: list_contains({_sql_list(KW.MOTIVATED_TAGS)}, x))) > 0 THEN 'motivated'
      WHEN len(list_filter(tags, lambda x: list_contains({_sql_list(KW.STRUGGLING_TAGS)}, x))) > 0 THEN 'struggling' ELSE 'neutral' END AS label FROM l""")
def q_d9(spark, sf):
    """Two tags a row, one in capitals."""
    return _docs(spark, sf).select("doc_id", KW.tags_to_class(F.array(F.upper(_pick(_TAGS)), _pick(_TAGS, "n_chars"))).alias("label"))


@register("source_nested_json", """
    SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS meta FROM documents""")
def q_nested(spark, sf):
    """A6."""
    rows = _docs(spark, sf).select("doc_id", F.struct("lang", "source", "n_chars").alias("meta"))
    return rows.select("doc_id", FL.nested_to_json("meta").alias("meta"))


@register("source_json_tree", "SELECT doc_id, source, text FROM documents")
def q_tree(spark, sf):
    """A folder of JSON files (a list of up to 200 documents each) below one folder for each group, read back whole."""
    path = _scratch(spark, "json-tree")
    rows = _docs(spark, sf).select("doc_id", "source", "text").withColumn("part", F.floor(F.col("doc_id") / 200))
    lists = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("doc_id", "source", "text"))).alias("value"))
    lists.repartition("part").write.partitionBy("part").text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])
    return FL.read_json_tree(spark, path, schema)


_STATES_SQL = """
    s AS (SELECT user_id AS u, count(*) AS n, CAST(max(ts) AS DATE) AS last FROM events GROUP BY user_id)"""


def _saved_states(spark, sf):
    """A user state for each user of ``events``, keys missing in some, saved many to a file: lists of states and single ones in one folder."""
    u = F.col("user_id")
    log = F.struct(
        F.col("event_type").alias("activity"), (F.col("event_id") % 480).cast("int").alias("duration"), F.when(F.col("event_id") % 4 > 0, F.lit("light")).alias("intensity"),
        (F.col("event_id") % 900).cast("int").alias("xp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("logged_at"),
    )
    logs = F.sort_array(F.collect_list(F.when(F.col("event_id") % 10 == 0, F.struct("event_id", log.alias("log")))))
    users = read_table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"), logs.alias("logs"))
    build = lambda name, xp: F.struct(F.lit(name).alias("build"), xp.alias("total_xp"))
    state = F.struct(
        u.cast("string").alias("user_id"), F.when(u % 2 == 0, F.concat(F.lit("user "), u.cast("string"))).alias("username"),
        build("strength", F.col("n")).alias("primary_build"), F.when(u % 4 == 1, build("gamer", F.col("n") * 2)).alias("secondary_build"),
        F.when(u % 6 == 2, F.array(build("wellness", u), build("creative", u + 1))).alias("legacy_builds"),
        F.when(u % 3 != 0, F.col("n") % 30).alias("current_streak"), F.when(u % 5 != 0, u % 4).alias("shields_remaining"),
        F.date_format("ts", "yyyy-MM-dd").alias("last_activity_date"), F.when(u % 7 != 0, F.transform("logs", lambda x: x["log"])).alias("activity_history"),
    )
    path = _scratch(spark, "states")
    single = users.where(u % 3 == 0).select(F.to_json(state).alias("value"))
    listed = users.where(u % 3 != 0).groupBy(F.floor(u / 12)).agg(F.to_json(F.collect_list(state)).alias("value")).select("value")
    single.unionByName(listed).write.text(path)
    return ST.load_user_states(spark, path, lines=True)


@register("source_user_states", f"""
    WITH {_STATES_SQL}
    SELECT CAST(u AS VARCHAR) AS user_id, CASE WHEN u % 2 = 0 THEN 'user ' || u ELSE CAST(u AS VARCHAR) END AS username,
           'strength' AS build, n AS total_xp, CAST(CASE WHEN u % 3 = 0 THEN 0 ELSE n % 30 END AS INTEGER) AS current_streak,
           CAST(CASE WHEN u % 5 = 0 THEN 4 ELSE u % 4 END AS INTEGER) AS shields_remaining, last AS last_activity_date
    FROM s""")
def q_states(spark, sf):
    """Saved states, list and object roots in one folder, loaded with the defaults."""
    return _saved_states(spark, sf).select(
        "user_id", "username", "primary_build.build", "primary_build.total_xp", "current_streak", "shields_remaining", "last_activity_date"
    )


@register("source_user_builds", f"""
    WITH {_STATES_SQL}
    SELECT CAST(u AS VARCHAR) AS user_id, kind, build, CAST(xp AS BIGINT) AS total_xp, kind = 'legacy' AS is_legacy FROM (
      SELECT u, 'primary' AS kind, 'strength' AS build, n AS xp FROM s
      UNION ALL SELECT u, 'secondary', 'gamer', n * 2 FROM s WHERE u % 4 = 1
      UNION ALL SELECT u, 'legacy', 'wellness', u FROM s WHERE u % 6 = 2 UNION ALL SELECT u, 'legacy', 'creative', u + 1 FROM s WHERE u % 6 = 2)""")
def q_state_builds(spark, sf):
    """Primary, secondary and legacy builds as rows."""
    return ST.builds(_saved_states(spark, sf))


@register("source_activity_history", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, event_type AS activity,
           CAST(event_id % 480 AS INTEGER) AS duration, CASE WHEN event_id % 4 > 0 THEN 'light' END AS intensity, CAST(event_id % 900 AS INTEGER) AS xp,
           CAST(NULL AS VARCHAR) AS notes, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS logged_at
    FROM events WHERE event_id % 10 = 0 AND user_id % 7 <> 0""")
def q_activity_history(spark, sf):
    """The logged activities of the saved states as rows."""
    return ST.activity_history(_saved_states(spark, sf))


_REQUESTS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'ab' WHEN 1 THEN repeat('x', 33) WHEN 2 THEN NULL ELSE 'user_' || user_id END AS user_id,
      CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN repeat('y', 51) ELSE 'User ' || user_id END AS username,
      CASE event_id % 5 WHEN 0 THEN 'wizard' WHEN 1 THEN 'Strength' ELSE 'gamer' END AS build,
      CAST(floor(value) + 1 AS INT) AS duration_minutes, CASE event_id % 4 WHEN 0 THEN 'Intense' WHEN 1 THEN 'extreme' ELSE 'light' END AS intensity,
      CASE event_id % 11 WHEN 0 THEN repeat('n', 201) WHEN 1 THEN NULL ELSE 'note' END AS notes FROM events"""
_REQUEST_CHECKS = {
    "user_id_length": "length(user_id) BETWEEN 3 AND 32", "username_length": "length(username) BETWEEN 1 AND 50", "unknown_build": f"lower(build) IN ({', '.join(S.q(b) for b in K.BUILDS)})",
    "duration_range": f"duration_minutes BETWEEN {K.DURATION_MINUTES[0]} AND {K.DURATION_MINUTES[1]}",
    "unknown_intensity": f"lower(intensity) IN ({', '.join(S.q(n) for n, _ in K.INTENSITY)})", "notes_length": "coalesce(length(notes), 0) <= 200",
}


def _reasons_sql(checks: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({v}, false) THEN '{k}' END" for k, v in checks.items()) + "], lambda x: x IS NOT NULL)"


@register("activity_validate_requests", f"""
    SELECT event_id, array_to_string({_reasons_sql(_REQUEST_CHECKS)}, ',') AS reasons, len({_reasons_sql(_REQUEST_CHECKS)}) = 0 AS is_valid FROM ({_REQUESTS})""")
def q_validate_requests(spark, sf):
    """Profile and log requests made of ``events``, every failed rule in one pass."""
    read_table(spark, sf, "events").createOrReplaceTempView("_request_events")
    requests = spark.sql(_REQUESTS.replace("FROM events", "FROM _request_events"))
    rows = C.validate_rows(requests, C.request_checks())
    return rows.select("event_id", F.array_join("reasons", ",").alias("reasons"), "is_valid")


_FEATURE_CHECKS = {**{c: f"{c} >= 0" for c in ("activities_per_day", "daily_xp_total", "streak_gap_days", "avg_session_duration", "max_session_duration", "xp_per_minute")},
                   **{c: f"{c} BETWEEN 0.0 AND 1.0" for c in ("intensity_switch_rate", "sessions_at_cap_ratio")}}
# user-days with some values out of range
_SPOILED = {"activities_per_day": "CASE WHEN user_id % 9 = 0 THEN -1 ELSE activities_per_day END", "intensity_switch_rate": "CASE WHEN user_id % 8 = 0 THEN intensity_switch_rate + 0.7 ELSE intensity_switch_rate END",
            "xp_per_minute": "CASE WHEN user_id % 10 = 0 THEN NULL ELSE xp_per_minute END"}


@register("anomaly_validate_features", f"""
    WITH {_features_sql()}, x AS (SELECT * REPLACE ({", ".join(f"{v} AS {k}" for k, v in _SPOILED.items())}) FROM feat)
    SELECT user_id, day, array_to_string({_reasons_sql(_FEATURE_CHECKS)}, ',') AS reasons, len({_reasons_sql(_FEATURE_CHECKS)}) = 0 AS is_valid FROM x""")
def q_validate_features(spark, sf):
    """Feature rows checked for their ranges before they are scored."""
    f = AN.user_day_features(activity_log(spark, sf)).withColumns({k: F.expr(v) for k, v in _SPOILED.items()})
    rows = C.validate_rows(f, C.feature_checks())
    return rows.select("user_id", "day", F.array_join("reasons", ",").alias("reasons"), "is_valid")
