"""Registered dialogue queries over ``conversations``, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keywords as KW
from ..functions import text as T
from ..operators import corpus as C
from ..operators import formatting as FM
from ..sources.tables import read_table
from . import params as P
from . import sql_text as S
from .registry import register


def conv(spark, sf):
    return read_table(spark, sf, "conversations")


PAIRS_SQL = """
    SELECT conv_id, user_turn, "user", assistant FROM (
      SELECT conv_id, turn AS user_turn, role, {strip_u} AS "user", {strip_a} AS assistant, next_role, next_turn FROM (
        SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
               lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn
        FROM conversations))
    WHERE next_turn IS NOT NULL {role_cond} AND length("user") > 0 AND length(assistant) > {min_reply}"""


def _pairs_sql(roles: bool, min_reply: int) -> str:
    return PAIRS_SQL.format(
        strip_u=S.py_strip("coalesce(text, '')"), strip_a=S.py_strip("coalesce(next_text, '')"),
        role_cond="AND role = 'user' AND next_role = 'assistant'" if roles else "", min_reply=min_reply,
    )


@register("dialogue_pairs", _pairs_sql(True, 20))
def q_dialogue_pairs(spark, sf):
    return C.adjacent_pairs(conv(spark, sf), min_reply=20)


@register("dialogue_pairs_any_role", _pairs_sql(False, 30))
def q_dialogue_pairs_any(spark, sf):
    return C.adjacent_pairs(conv(spark, sf), first_role=None, second_role=None, min_reply=30)


_STRIP_TEXT = S.py_strip("coalesce(text, '')")


@register("dialogue_first_exchange", f"""
    SELECT conv_id, "user", assistant FROM (
      SELECT conv_id,
             arg_min({_STRIP_TEXT}, turn) FILTER (WHERE role = 'user' AND {_STRIP_TEXT} <> '') AS "user",
             arg_min({_STRIP_TEXT}, turn) FILTER (WHERE role = 'assistant' AND {_STRIP_TEXT} <> '') AS assistant
      FROM conversations GROUP BY conv_id)
    WHERE "user" IS NOT NULL AND assistant IS NOT NULL""")
def q_first_exchange(spark, sf):
    return C.first_exchange(conv(spark, sf))


@register("dialogue_first_two_turns", """
    WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    c AS (SELECT conv_id, count(*) AS n, max(CASE WHEN rn = 1 THEN role END) AS role1,
                 max(CASE WHEN rn = 1 THEN text END) AS text1, max(CASE WHEN rn = 2 THEN text END) AS text2 FROM t GROUP BY conv_id),
    f AS (SELECT doc_id AS conv_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS instruction, lang AS input,
                 CASE WHEN doc_id % 2 = 0 THEN NULL ELSE text END AS output, substr(text, 1, 60) AS response FROM documents),
    x AS (SELECT coalesce(c.conv_id, f.conv_id) AS conv_id,
                 CASE WHEN n >= 2 THEN CASE WHEN role1 = 'user' THEN text1 END ELSE coalesce(instruction, input) END AS "user",
                 CASE WHEN n >= 2 THEN text2 ELSE coalesce(output, response) END AS assistant
          FROM c FULL JOIN f ON c.conv_id = f.conv_id)
    SELECT conv_id, "user", assistant FROM x WHERE length("user") > 0 AND length(assistant) >= 40""")
def q_first_two_turns(spark, sf):
    """``conversations``, with ``documents`` as the flat records of ids without two turns."""
    d = read_table(spark, sf, "documents")
    flat = d.select(
        F.col("doc_id").alias("conv_id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("instruction"), F.col("lang").alias("input"),
        F.when(F.col("doc_id") % 2 != 0, F.col("text")).alias("output"), F.substring("text", 1, 60).alias("response"),
    )
    return C.first_two_turns(conv(spark, sf), flat=flat)


@register("dialogue_utterance_pairs", f"""
    WITH t AS (SELECT conv_id, turn, {S.py_strip("array_to_string(string_split(text, chr(10)), ' ')")} AS said FROM conversations WHERE text IS NOT NULL),
    p AS (SELECT conv_id, turn AS user_turn, said AS "user", lead(said) OVER (PARTITION BY conv_id ORDER BY turn) AS assistant FROM t)
    SELECT conv_id, user_turn, "user", assistant FROM p WHERE length("user") > 0 AND length(assistant) > 30""")
def q_utterance_pairs(spark, sf):
    """Turns as lists of utterances (a turn's lines)."""
    turns = conv(spark, sf).where("text IS NOT NULL").select("conv_id", "turn", F.split("text", "\n").alias("utterances"))
    return C.utterance_pairs(turns)


@register("dialogue_parent_child", f"""
    SELECT c.conv_id, c.turn, {S.py_strip("coalesce(p.text, '')")} AS "user", {S.py_strip("coalesce(c.text, '')")} AS assistant
    FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
    WHERE c.role = 'assistant' AND p.role = 'user' AND (c.conv_id % 4 <> 1)
      AND length({S.py_strip("coalesce(p.text, '')")}) > 0 AND length({S.py_strip("coalesce(c.text, '')")}) > 0""")
def q_parent_child(spark, sf):
    """B13 on a message table whose ids are (conversation, turn) pairs; languages en, fr and none in turn."""
    lang = F.when(F.col("conv_id") % 4 == 1, "fr").when(F.col("conv_id") % 4 == 2, "en")
    m = conv(spark, sf).select(
        F.struct("conv_id", "turn").alias("message_id"),
        F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("parent_id"), "role", "text", lang.alias("lang"),
    )
    out = C.parent_child_pairs(m, "message_id", "parent_id", lang="lang")
    return out.select("message_id.conv_id", "message_id.turn", "user", "assistant")


def _posts_comments(spark, sf):
    """Stand-in posts/comments: a post per conversation (first user message: first
    line = title, rest = body, score = 2 x turns); comments = assistant turns
    (score = number of lines)."""
    c = conv(spark, sf)
    first_user = c.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    nturns = c.groupBy("conv_id").agg((F.count(F.lit(1)) * 2).alias("score"))
    posts = first_user.join(nturns, "conv_id").select(
        F.col("conv_id").alias("post_id"),
        F.split(T.nz("t"), "\n").getItem(0).alias("title"),
        F.regexp_extract(T.nz("t"), r"(?s)^[^\n]*\n(.*)$", 1).alias("selftext"),
        "score", F.lit(True).alias("is_self"),
    )
    comments = c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("post_id"), F.col("turn").alias("pos"), F.col("text").alias("body"),
        F.size(F.split(T.nz("text"), "\n")).cast("long").alias("score"),
    )
    return posts, comments


@register("dialogue_post_best_comment", f"""
    WITH fu AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
    nt AS (SELECT conv_id, count(*) * 2 AS score FROM conversations GROUP BY conv_id),
    posts AS (
      SELECT fu.conv_id AS post_id, {S.clean_post("split_part(coalesce(t, ''), chr(10), 1)")} AS title,
             {S.clean_post(r"regexp_extract(coalesce(t, ''), '(?s)^[^\n]*\n(.*)$', 1)")} AS selftext, nt.score AS post_score
      FROM fu JOIN nt ON nt.conv_id = fu.conv_id),
    comments AS (
      SELECT conv_id AS post_id, turn AS pos, {S.clean_post('text')} AS body,
             len(string_split(coalesce(text, ''), chr(10))) AS answer_score
      FROM conversations WHERE role = 'assistant'),
    good AS (SELECT * FROM comments WHERE body <> '' AND answer_score > 0 AND length(body) > 60),
    best AS (SELECT post_id, body, answer_score FROM (
      SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY answer_score DESC, pos) AS rn FROM good) WHERE rn = 1)
    SELECT p.post_id, p.post_score,
           CASE WHEN length(p.selftext) > 20 THEN p.title || chr(10) || chr(10) || substr(p.selftext, 1, 600) ELSE p.title END AS question,
           substr(b.body, 1, 2000) AS answer, b.answer_score
    FROM posts p JOIN best b ON b.post_id = p.post_id
    WHERE p.title <> '' AND p.post_score >= 10""")
def q_post_best_comment(spark, sf):
    posts, comments = _posts_comments(spark, sf)
    return C.post_best_comment(posts, comments)


def _first_system(c):
    return c.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))


@register("dialogue_persona_retag", f"""
    WITH sys AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
    fx AS (
      SELECT conv_id, "user", assistant FROM (
        SELECT conv_id,
               arg_min({_STRIP_TEXT}, turn) FILTER (WHERE role = 'user' AND {_STRIP_TEXT} <> '') AS "user",
               arg_min({_STRIP_TEXT}, turn) FILTER (WHERE role = 'assistant' AND {_STRIP_TEXT} <> '') AS assistant
        FROM conversations GROUP BY conv_id)
      WHERE "user" IS NOT NULL AND assistant IS NOT NULL),
    x AS (SELECT fx.*, coalesce(sys.system, '') || CASE WHEN fx.conv_id % 9 < 7 THEN ' You are ' || [{", ".join(S.q(c) for c in KW.CLASS_ORDER)}][CAST(fx.conv_id % 9 AS INTEGER) + 1] ELSE '' END AS system
          FROM fx LEFT JOIN sys ON sys.conv_id = fx.conv_id),
    y AS (SELECT *, (CASE {" ".join(f"WHEN contains(system, '{c}') THEN '{c}'" for c in KW.CLASS_ORDER)} ELSE 'GENERIC' END) AS persona,
                 {S.best_class(S.class_score_cols('"user" || \' \' || assistant', P.DEMO_KEYWORDS))} AS best_class
          FROM x WHERE "user" <> '' AND assistant <> ''),
    z AS (SELECT *, CASE WHEN persona = 'GENERIC' THEN best_class ELSE persona END AS class FROM y)
    SELECT conv_id, persona, best_class, class,
           coalesce(CASE {" ".join(f"WHEN class = '{k}' THEN {S.q(v)}" for k, v in P.PERSONAS.items())} END, system) AS system_out
    FROM z""")
def q_persona_retag(spark, sf):
    c = conv(spark, sf)
    # seven of nine system texts name a class
    k = F.pmod(F.col("conv_id"), F.lit(9)).cast("int")
    named = F.when(k < 7, F.concat(F.lit(" You are "), F.element_at(F.array(*[F.lit(x) for x in KW.CLASS_ORDER]), F.least(k, F.lit(6)) + 1))).otherwise("")
    fx = C.first_exchange(c).join(_first_system(c), "conv_id", "left").withColumn("system", F.concat(T.nz("system"), named))
    text = F.concat(F.col("user"), F.lit(" "), F.col("assistant"))
    r = C.retag_generic(fx, "system", text, P.DEMO_KEYWORDS, P.PERSONAS)
    return r.select("conv_id", "persona", "best_class", "class", "system_out")


def _said(spark, sf):
    """``conversations`` with one of ``SAID`` added to each text in turn."""
    add = F.element_at(F.array(*[F.lit(x) for x in P.SAID]), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(P.SAID))) + 1).cast("int"))
    return conv(spark, sf).withColumn("text", F.concat(T.nz("text"), F.lit(" "), add))


_SAID_SQL = f"""(SELECT conv_id, turn, role, coalesce(text, '') || ' ' ||
      [{", ".join(S.q(x) for x in P.SAID)}][CAST((conv_id * 7 + turn) % {len(P.SAID)} AS INTEGER) + 1] AS text FROM conversations)"""
_S_HITS, _M_HITS = S.lexicon_hits("coalesce(text, '')")


@register("dialogue_lexicon", f"""
    SELECT conv_id, turn, CAST(s AS INTEGER) AS s_hits, CAST(m AS INTEGER) AS m_hits,
           CASE WHEN s > m THEN 'struggling' WHEN m > s THEN 'motivated' END AS lex_class,
           CAST(CASE WHEN s > m THEN s WHEN m > s THEN m ELSE 0 END AS INTEGER) AS lex_hits
    FROM (SELECT conv_id, turn, {_S_HITS} AS s, {_M_HITS} AS m FROM {_SAID_SQL})""")
def q_lexicon(spark, sf):
    c = _said(spark, sf)
    s, m = KW.lexicon_hits(T.nz("text"))
    c = c.select("conv_id", "turn", s.alias("s_hits"), m.alias("m_hits"))
    cls, hits = KW.lexicon_class(F.col("s_hits"), F.col("m_hits"))
    return c.select("conv_id", "turn", "s_hits", "m_hits", cls.alias("lex_class"), hits.alias("lex_hits"))


@register("dialogue_routing", f"""
    SELECT conv_id, turn, {S.route_message("coalesce(text, '')", "lex_class")} AS mode FROM (
      SELECT conv_id, turn, text, CASE WHEN s > m THEN 'struggling' WHEN m > s THEN 'motivated' END AS lex_class
      FROM (SELECT conv_id, turn, text, {_S_HITS} AS s, {_M_HITS} AS m FROM {_SAID_SQL} WHERE role = 'user'))""")
def q_routing(spark, sf):
    c = _said(spark, sf).where(F.col("role") == "user")
    s, m = KW.lexicon_hits(T.nz("text"))
    cls, _ = KW.lexicon_class(s, m)
    return c.select("conv_id", "turn", KW.route_message(T.nz("text"), cls).alias("mode"))


# ----------------------------------------------------------------- formatting

def _hdr(role_sql: str) -> str:
    return f"'{FM.HDR_START}' || {role_sql} || '{FM.HDR_END}' || chr(10) || chr(10)"


def _train_sql(sys_sql, u, a):
    return (f"'{FM.BOS}' || {_hdr(S.q('system'))} || {S.py_strip(sys_sql)} || '{FM.EOT}' || {_hdr(S.q('user'))} || "
            f"{S.py_strip(u)} || '{FM.EOT}' || {_hdr(S.q('assistant'))} || {S.py_strip(a)} || '{FM.EOT}'")


_PAIRS_CTE = f"pairs AS ({_pairs_sql(True, 20)})"


@register("prompt_training_text", f"""
    WITH {_PAIRS_CTE}
    SELECT conv_id, user_turn, {_train_sql(S.q(P.SYSTEM_TEXT), '"user"', 'assistant')} AS text,
           '{FM.BOS}' || {_hdr(S.q('system'))} || {S.q(P.SYSTEM_TEXT)} || '{FM.EOT}' || {_hdr(S.q('user'))} || {S.py_strip('"user"')}
             || '{FM.EOT}' || {_hdr(S.q('assistant'))} AS prompt
    FROM pairs""")
def q_training_text(spark, sf):
    p = C.adjacent_pairs(conv(spark, sf), min_reply=20)
    return p.select(
        "conv_id", "user_turn",
        FM.training_text(F.lit(P.SYSTEM_TEXT), F.col("user"), F.col("assistant")).alias("text"),
        FM.inference_text(F.lit(P.SYSTEM_TEXT), F.col("user")).alias("prompt"),
    )


@register("prompt_format_check", f"""
    WITH {_PAIRS_CTE}, t AS (SELECT {_train_sql(S.q(P.SYSTEM_TEXT), '"user"', 'assistant')} AS text FROM pairs),
    k AS (SELECT {" AND ".join(f"contains(text, {S.q(m)})" for m in FM.REQUIRED_MARKERS)} AS ok FROM t)
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT ok) AS n_bad, coalesce(bool_and(ok), true) AS all_ok FROM k""")
def q_format_check(spark, sf):
    p = C.adjacent_pairs(conv(spark, sf), min_reply=20)
    return FM.format_check(p.select(FM.training_text(F.lit(P.SYSTEM_TEXT), F.col("user"), F.col("assistant")).alias("text")))


@register("prompt_multi_turn", f"""
    WITH chat AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')),
    lu AS (SELECT conv_id, max(turn) AS t, arg_max(text, turn) AS x FROM chat WHERE role = 'user' GROUP BY conv_id),
    h AS (SELECT c.conv_id, c.turn, c.role, c.text,
                 row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS k
          FROM chat c JOIN lu ON lu.conv_id = c.conv_id WHERE c.turn < lu.t),
    hs AS (SELECT conv_id, string_agg({_hdr('role')} || {S.py_strip("coalesce(text, '')")} || '{FM.EOT}', '' ORDER BY turn) AS hist
           FROM h WHERE k <= 10 GROUP BY conv_id)
    SELECT lu.conv_id, '{FM.BOS}' || {_hdr(S.q('system'))} || {S.q(P.SYSTEM_TEXT)} || '{FM.EOT}' || coalesce(hs.hist, '')
           || {_hdr(S.q('user'))} || {S.py_strip("coalesce(lu.x, '')")} || '{FM.EOT}' || {_hdr(S.q('assistant'))} AS prompt
    FROM lu LEFT JOIN hs ON hs.conv_id = lu.conv_id""")
def q_multi_turn(spark, sf):
    return FM.multi_turn_prompts(conv(spark, sf), P.SYSTEM_TEXT, keep_last=10)
