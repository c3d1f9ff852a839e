"""Corpus extraction and curation: pairing, projection, classification,
dedup, quotas, top-ups, splits, sampling and reports.

Order-dependent rules (first wins, first N, quotas, splits) need an explicit
total order: the caller passes order columns. Ranks come from
``row_numbers`` (range-partitioned windows), never from one window task per
group, because one class or source may hold a third of all rows. First-wins
dedup is an aggregate (``min_by``), which combines map-side.
Shuffles are deterministic: ``md5(seed || ':' || key)`` orders rows, so an
independent SQL engine reproduces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions import keywords as KW
from ..functions import text as T
from ..session import ensure_checkpoint_dir
from ..functions.scan import first_rows, row_numbers, running_aggregates
from . import bloom
from .selection import mark_first


def shuffle_key(seed: int | str, key) -> Column:
    """Deterministic shuffle order: md5 of ``seed:key``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


# ----------------------------------------------------------------- projection

def qa_projection(df: DataFrame, q: str, a: str, min_answer: int = 0) -> DataFrame:
    """Strip both sides, drop if either is empty or the answer is not
    longer than ``min_answer`` characters."""
    return (
        df.withColumn("user", T.py_strip(T.nz(q)))
        .withColumn("assistant", T.py_strip(T.nz(a)))
        .where((F.length("user") > 0) & (F.length("assistant") > min_answer))
    )


def first_n_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per group in ``order`` (counted after
    any filters already applied)."""
    return first_rows(df, keys, order, n)


# -------------------------------------------------------------------- pairing

def adjacent_pairs(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    first_role: str | None = "user", second_role: str | None = "assistant", min_reply: int = 20,
) -> DataFrame:
    """A turn and the next turn of the same conversation; with roles
    given, only first_role -> second_role. Reply must be longer than
    ``min_reply`` after stripping. The next turn is a ``lag`` over descending
    turn order from the range-partitioned scan, so one very long conversation
    is still split across tasks."""
    t = turns.select(conv, turn, role, text).withColumn("_neg_turn", -F.col(turn))
    x = running_aggregates(
        t, [conv], ["_neg_turn"], {"_next_role": (role, "lag"), "_next_text": (text, "lag"), "_next_turn": (turn, "lag")}
    ).where(F.col("_next_turn").isNotNull())
    if first_role is not None:
        x = x.where((F.col(role) == first_role) & (F.col("_next_role") == second_role))
    x = x.select(
        F.col(conv), F.col(turn).alias("user_turn"),
        T.py_strip(T.nz(text)).alias("user"), T.py_strip(T.nz("_next_text")).alias("assistant"),
    )
    return x.where((F.length("user") > 0) & (F.length("assistant") > min_reply))


def first_exchange(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """First non-empty user message and first non-empty assistant message
    per conversation (``min_by``: a partial aggregate, no window)."""
    t = T.py_strip(T.nz(text))
    return (
        turns.groupBy(conv)
        .agg(
            F.min_by(t, F.when((F.col(role) == "user") & (t != ""), F.col(turn))).alias("user"),
            F.min_by(t, F.when((F.col(role) == "assistant") & (t != ""), F.col(turn))).alias("assistant"),
        )
        .where(F.col("user").isNotNull() & F.col("assistant").isNotNull())
    )


def first_two_turns(
    turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text", human: str = "user", min_reply: int = 40,
    flat: DataFrame | None = None,
) -> DataFrame:
    """The first two turns of each conversation: the first must come from
    ``human``, the reply is the second turn, whoever speaks, with at least
    ``min_reply`` characters. Conversations of fewer than two turns fall back
    to ``flat`` (conv, instruction, input, output, response): the instruction (or the
    input, if there is no instruction column value) and the output (or response).

    One aggregate: the two turns with the smallest numbers, combined map-side."""
    one = F.struct(F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"))
    first = turns.groupBy(conv).agg(F.min_by(one, turn).alias("a"), F.count(F.lit(1)).alias("n_turns"))
    if flat is not None:
        first = first.join(flat, conv, "full")
    later = turns.join(first.where("n_turns >= 2").select(conv, F.col("a.n").alias("_n")), conv).where(F.col(turn) > F.col("_n"))
    reply = later.groupBy(conv).agg(F.min_by(F.col(text), turn).alias("b"))
    x = first.join(reply, conv, "left")
    talks = F.coalesce(F.col("n_turns"), F.lit(0)) >= 2
    user = F.when(talks, F.when(F.col("a.r") == human, F.col("a.t")))
    answer = F.when(talks, F.col("b"))
    if flat is not None:
        user = F.when(~talks, F.coalesce("instruction", "input")).otherwise(user)
        answer = F.when(~talks, F.coalesce("output", "response")).otherwise(answer)
    out = x.select(conv, user.alias("user"), answer.alias("assistant"))
    return out.where((F.length("user") > 0) & (F.length("assistant") >= min_reply))


def utterance_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", utterances: str = "utterances", min_reply: int = 30) -> DataFrame:
    """Neighbouring turns of utterance lists: each side's utterances joined
    by a space and stripped; both sides non-empty, the reply longer than ``min_reply``."""
    said = turns.withColumn("_said", F.when(F.size(utterances) > 0, T.py_strip(F.array_join(utterances, " "))))
    rows = said.select(conv, turn, "_said", (-F.col(turn)).alias("_back"))
    rows = running_aggregates(rows, [conv], ["_back"], {"_reply": ("_said", "lag")})
    out = rows.select(conv, F.col(turn).alias("user_turn"), F.col("_said").alias("user"), F.col("_reply").alias("assistant"))
    return out.where((F.length("user") > 0) & (F.length("assistant") > min_reply))


def parent_child_pairs(
    msgs: DataFrame, msg_id: str, parent_id: str, role: str = "role", text: str = "text", lang: str | None = None,
    child_role: str = "assistant", parent_role: str = "user", want_lang: str = "en",
) -> DataFrame:
    """Child message of ``child_role`` whose parent has ``parent_role``;
    self equi-join on the parent id; missing language counts as ``want_lang``."""
    child = msgs.where(F.col(role) == child_role)
    if lang is not None:
        child = child.where(F.coalesce(F.col(lang), F.lit(want_lang)) == want_lang)
    parent = msgs.where(F.col(role) == parent_role).select(
        F.col(msg_id).alias("_pid"), F.col(text).alias("_ptext")
    )
    return child.join(parent, child[parent_id] == parent["_pid"]).select(
        F.col(msg_id).alias("message_id"),
        F.col(parent_id).alias("parent_id"),
        T.py_strip(T.nz("_ptext")).alias("user"),
        T.py_strip(T.nz(text)).alias("assistant"),
    ).where((F.length("user") > 0) & (F.length("assistant") > 0))


def post_best_comment(
    posts: DataFrame, comments: DataFrame, min_score: int = 10, min_comment_len: int = 60,
    body_cut: int = 600, answer_cut: int = 2000,
) -> DataFrame:
    """Posts (post_id, title, selftext, score, is_self) and comments
    (post_id, pos, body, score). Posts need a title, score >= ``min_score`` and
    text unless self posts; comments need score > 0 and cleaned body longer
    than ``min_comment_len``; the highest score wins, ties to the earlier
    position (``max_by`` aggregate). Question = title + first 600 characters
    of the body when the body is longer than 20; answer cut to 2000."""
    p = posts.select(
        "post_id", T.clean_post("title").alias("title"), T.clean_post("selftext").alias("selftext"),
        F.col("score").alias("post_score"), "is_self",
    ).where((F.col("title") != "") & (F.col("post_score") >= min_score) & ~((F.col("is_self") == F.lit(False)) & (F.col("selftext") == "")))
    c = comments.select("post_id", "pos", T.clean_post("body").alias("body"), F.col("score").alias("answer_score")).where(
        (F.col("body") != "") & (F.col("answer_score") > 0) & (F.length("body") > min_comment_len)
    )
    best = c.groupBy("post_id").agg(
        F.max_by(F.struct("body", "answer_score"), F.struct(F.col("answer_score"), -F.col("pos"))).alias("b")
    )
    q = F.when(F.length("selftext") > 20, F.concat(F.col("title"), F.lit("\n\n"), F.substring("selftext", 1, body_cut))).otherwise(F.col("title"))
    return p.join(best, "post_id").select(
        "post_id", "post_score", q.alias("question"),
        F.substring(F.col("b.body"), 1, answer_cut).alias("answer"), F.col("b.answer_score").alias("answer_score"),
    )


def transcript_pairs(df: DataFrame, id_col: str, transcript: str, problem: str) -> DataFrame:
    """Turns split on the EOM marker (stripped, empty ones dropped); each
    non-teacher turn followed by a teacher turn is a pair. Text after the first
    ':' of each turn; the teacher's leading "(tag)" is removed; empty sides
    dropped. A pair starting at the first turn gets the problem prefixed."""
    parts = F.filter(F.transform(F.split(T.nz(transcript), T.EOM_PATTERN, -1), lambda x: T.py_strip(x)), lambda x: x != "")
    turns = df.select(id_col, problem, F.posexplode(parts).alias("pos", "raw"))
    is_teacher = F.lower(F.col("raw")).startswith(T.TEACHER_PREFIX)
    after = F.when(F.instr("raw", ":") > 0, F.expr("substring(raw, instr(raw, ':') + 1)")).otherwise(F.col("raw"))
    w = Window.partitionBy(id_col).orderBy("pos")  # bounded by the transcript's length
    t = turns.withColumn("_teacher", is_teacher).withColumn("_body", T.py_strip(after))
    t = t.withColumn("_next_teacher", F.lead("_teacher").over(w)).withColumn("_next_body", F.lead("_body").over(w))
    pairs = t.where(~F.col("_teacher") & F.col("_next_teacher"))
    student = F.col("_body")
    teacher = T.py_strip(F.regexp_replace(F.col("_next_body"), r"^\([^)]+\)", ""))
    prob = T.py_strip(T.nz(problem))
    user = F.when((F.col("pos") == 0) & (prob != ""), F.concat(F.lit(T.MATH_PREFIX), prob, F.lit(T.STUDENT_PREFIX), student)).otherwise(student)
    return pairs.select(id_col, F.col("pos").alias("turn_pos"), user.alias("user"), teacher.alias("assistant")).where(
        (F.col("_body") != "") & (F.col("assistant") != "")
    )


def problem_solution_pair(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Problem -> worked solution with the fixed templates; both required."""
    q, a = T.py_strip(T.nz(question)), T.py_strip(T.nz(answer))
    return df.where((q != "") & (a != "")).select(
        "*", F.concat(F.lit(T.SOLVE_Q), q).alias("user"), F.concat(F.lit(T.SOLVE_A), a).alias("assistant")
    )


def last_exchange(df: DataFrame, id_col: str, blob: str, customer: str = T.CUSTOMER_MARK, agent: str = T.AGENT_MARK,
                  min_reply: int = 20) -> DataFrame:
    """From one dialogue blob holding both markers, the reply after the
    last agent marker (longer than ``min_reply``) and the first line after the
    last customer marker before it."""
    raw = T.py_strip(T.nz(blob))
    last_part = F.element_at(F.split(raw, F.lit(agent), -1), -1)
    reply = T.py_strip(last_part)
    block = F.substring(raw, F.lit(1), F.length(raw) - F.length(last_part) - len(agent))
    cust = T.py_strip(F.element_at(F.split(block, F.lit(customer), -1), -1))
    first_line = T.py_strip(F.element_at(F.split(cust, F.lit("\n"), -1), 1))
    has = F.contains(raw, F.lit(agent)) & F.contains(raw, F.lit(customer))
    return df.where(has).select(id_col, first_line.alias("user"), reply.alias("assistant")).where(
        (F.col("user") != "") & (F.length("assistant") > min_reply)
    )


# -------------------------------------------------------------- classification

def classify(df: DataFrame, text: Column, table: list[tuple[str, int, str]], order=KW.CLASS_ORDER,
             min_score: int = KW.MIN_CLASS_SCORE, mode: str = "substring") -> DataFrame:
    """Per-class keyword scores and the best class (NULL below the minimum)."""
    base = df.withColumn("_text_for_scores", text)
    scores = KW.class_scores(F.col("_text_for_scores"), table, mode)
    cols = [s.alias(f"score_{c}") for c, s in scores.items()]
    out = base.select("*", *cols).drop("_text_for_scores")
    named = {c: F.col(f"score_{c}") for c in scores}
    return out.withColumn("best_class", KW.best_class(named, order, min_score))


def detect_persona(system: Column, classes=KW.CLASS_ORDER, case_sensitive: bool = True, default: str = "GENERIC") -> Column:
    """D3: first class name contained in the system text, else ``default``."""
    s = system if case_sensitive else F.upper(system)
    expr = None
    for c in classes:
        cond = F.contains(s, F.lit(c))
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def retag_generic(df: DataFrame, system: str, text: Column, table, personas: dict[str, str]) -> DataFrame:
    """Rows whose system text names no class are classified from
    user+assistant; classified rows get that class's system text, the rest
    stay apart with ``best_class`` NULL. Rows with empty sides are dropped."""
    d = df.withColumn("persona", detect_persona(F.col(system)))
    d = d.where((F.col("user") != "") & (F.col("assistant") != ""))
    d = classify(d, text, table)
    new_class = F.when(F.col("persona") == "GENERIC", F.col("best_class")).otherwise(F.col("persona"))
    pmap = F.create_map(*[x for k, v in personas.items() for x in (F.lit(k), F.lit(v))])
    return d.withColumn("class", new_class).withColumn(
        "system_out", F.coalesce(pmap[F.col("class")], F.col(system))
    )


def cascade(df: DataFrame, text: Column, stages: list[tuple[str, list[str], int]], order: list[str]) -> DataFrame:
    """Priority cascade with quotas. In row order a row goes to the first
    stage whose quota is not yet full and whose keywords it contains. Exact as
    stages: stage i takes the first q_i rows (in order) matching its keywords
    among rows no earlier stage took."""
    # one pass over the texts: the order columns and which stages match; the stages then pick among those
    lower = F.lower(text)
    match = F.filter(F.array(*[F.when(KW.any_present(lower, kws), F.lit(i)) for i, (_, kws, _) in enumerate(stages)]), lambda x: x.isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(*order, match.alias("_match")).where(F.size("_match") > 0).checkpoint()
    taken = None
    for i, (cls, _, quota) in enumerate(stages):
        cand = rows.where(F.array_contains("_match", i)).select(*order)
        if taken is not None:
            cand = cand.join(taken.select(*order), order, "left_anti")
        pick = first_rows(cand, [], order, quota).withColumn("class", F.lit(cls))
        taken = pick if taken is None else taken.unionByName(pick)
    return df.join(taken, order)


# ---------------------------------------------------------------------- dedup

def dedup_first_wins(df: DataFrame, group: list[str], key: Column, order: list[str]) -> DataFrame:
    """Keep the first row (by ``order``) per (group, key). ``min_by`` is a
    partial aggregate: a hot key is combined map-side, not collected. The whole
    row travels through the shuffle, so project to the needed columns first."""
    cols = [c for c in df.columns]
    d = df.withColumn("_key", key)
    agg = d.groupBy(*group, "_key").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return agg.select("_r.*")


def incremental_dedup(new: DataFrame, existing: DataFrame, key_new: Column, key_old: Column) -> DataFrame:
    """Drop new rows whose key an existing row already has; rows that a Bloom filter of the
    existing keys turns away are kept without a shuffle, the others meet an exact anti-join."""
    old_keys = existing.select(key_old.alias("_key")).distinct()
    return bloom.anti_join(new.withColumn("_key", key_new), old_keys, "_key").select(*new.columns)


def ordered_union(df: DataFrame, source_order: str, key: Column, order: list[str]) -> DataFrame:
    """Sources in order; a key belongs to the earliest source that has it,
    and within a source to its first row."""
    return dedup_first_wins(df, [], key, [source_order, *order])


def key_set_union(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column) -> DataFrame:
    """Keys in either set, once."""
    return a.select(key_a.alias("key")).union(b.select(key_b.alias("key"))).distinct()


# --------------------------------------------------------- quotas and top-ups

def quota(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows per group, first in order."""
    return first_n_per_group(df, keys, order, cap)


def need_based_topup(
    current: DataFrame, candidates: DataFrame, target: int, extra: int = 200, class_col: str = "class",
    source_order: str = "source_order", max_col: str = "max_samples", order: list[str] | None = None,
) -> DataFrame:
    """E5: for each class under ``target``, take ``min(need + extra, max)``
    candidates from each source in source order, the need recomputed after
    each source. ``current`` has (class, n). The per-class fold runs over the
    class's source summaries (bounded by the number of sources)."""
    order = order or ["row_no"]
    per_src = candidates.groupBy(class_col, source_order).agg(
        F.count(F.lit(1)).alias("_avail"), F.first(max_col).alias("_max")
    )
    summ = per_src.groupBy(class_col).agg(F.sort_array(F.collect_list(F.struct(source_order, "_avail", "_max"))).alias("_srcs"))
    summ = summ.join(current.select(class_col, F.col("n").alias("_n0")), class_col, "left").withColumn("_n0", F.coalesce("_n0", F.lit(0)))

    def step(acc, s):
        cur = acc["cur"]
        take = F.when(cur < target, F.least(F.lit(target) - cur + extra, s["_max"], s["_avail"])).otherwise(F.lit(0)).cast("long")
        return F.struct(
            (cur + take).cast("long").alias("cur"),
            F.array_append(acc["takes"], F.struct(s[source_order].alias(source_order), take.alias("take"))).alias("takes"),
        )

    init = F.struct(F.col("_n0").cast("long").alias("cur"), F.array().cast(f"array<struct<{source_order}:int,take:bigint>>").alias("takes"))
    takes = summ.select(class_col, F.explode(F.aggregate(F.col("_srcs"), init, step)["takes"]).alias("t")).select(
        class_col, F.col("t").getField(source_order).alias(source_order), F.col("t.take").alias("_take")
    )
    narrow = candidates.select(*dict.fromkeys([class_col, source_order, *order]))
    ranked = row_numbers(narrow, [class_col, source_order], order, "_rn")
    # one row for each class and source; Spark chooses the join
    picked = ranked.join(takes, [class_col, source_order]).where(F.col("_rn") <= F.col("_take"))
    return candidates.join(picked.select(*narrow.columns), narrow.columns)


def class_cap(df: DataFrame, class_col: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per class after a deterministic shuffle."""
    d = df.withColumn("_h", shuffle_key(seed, key))
    return first_n_per_group(d, [class_col], ["_h", key], cap).drop("_h")


# --------------------------------------------------------------------- splits

def split_per_class(df: DataFrame, class_col: str, key: str, frac: float = 0.9, min_one: bool = True, seed: int = 42) -> DataFrame:
    """Per class, shuffled; the first ``max(1, int(frac*n))`` rows (or
    ``int(frac*n)``) are train, the rest val. Adds ``split``; ``key`` is unique."""
    k = F.floor(F.col("n") * F.lit(frac))
    if min_one:
        k = F.greatest(F.lit(1), k)
    return mark_first(df, [class_col], shuffle_key(seed, key), k, "train", "val")


def global_split(df: DataFrame, key: str, frac: float = 0.9, seed: int = 42) -> DataFrame:
    """Exact-size shuffled split over all rows: the first ``int(frac*N)``
    in md5 order of the unique ``key`` are train."""
    return mark_first(df, [], shuffle_key(seed, key), F.floor(F.col("n") * F.lit(frac)), "train", "val")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Per label ``ceil(test*n)`` rows (md5 order of the unique ``key``) go to test."""
    return mark_first(df, [label], shuffle_key(seed, key), F.ceil(F.col("n") * F.lit(test)), "test", "train")


def downsample(df: DataFrame, label: str, key: str, cap: int, labels: list[str], seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per known label (md5 order); unknown labels dropped."""
    d = df.where(F.col(label).isin(*labels)).withColumn("_h", shuffle_key(seed, key))
    return first_n_per_group(d, [label], ["_h", key], cap).drop("_h")


def oversample(df: DataFrame, label: str, cls: str, key: str, frac: float = 0.12, seed: int = 42) -> DataFrame:
    """Add draws with replacement from class ``cls`` until it has
    ``int(total*frac)`` rows (total before adding); no-op if it has enough.
    Draw i picks the row of rank ``md5_number(seed:i) mod n_cls + 1`` (the
    first 15 hex digits of the md5 as an integer). The draws are a distributed
    ``range``; only ids are ranked and joined to the draws, the rows follow by id."""
    spark = df.sparkSession
    c = df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(label) == cls, 1)).alias("n_cls")).first()
    total, n_cls = int(c["total"]), int(c["n_cls"])
    need = int(total * frac) - n_cls
    if need <= 0 or n_cls == 0:
        return df
    draw = F.col("id")
    h = F.conv(F.substring(shuffle_key(seed, draw), 1, 15), 16, 10).cast("long")
    draws = spark.range(0, need).select((F.pmod(h, F.lit(n_cls)) + 1).alias("_rn"))
    own = df.where(F.col(label) == cls)
    picks = draws.join(row_numbers(own.select(key), [], [key], "_rn"), "_rn").groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
    extra = own.join(picks, key).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return df.unionByName(extra.select(*df.columns))


# -------------------------------------------------------------------- reports

def class_report(df: DataFrame, class_col: str, classes: list[str], target: int) -> DataFrame:
    """Count per class for a fixed class list (absent -> 0), status and shortfall."""
    spark = df.sparkSession
    cl = spark.createDataFrame([(i, c) for i, c in enumerate(classes)], f"class_order int, {class_col} string")
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    r = F.broadcast(cl).join(counts, class_col, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return r.select(
        "class_order", class_col, "n",
        F.when(F.col("n") >= target, "OK").otherwise("LOW").alias("status"),
        F.greatest(F.lit(0), F.lit(target) - F.col("n")).cast("long").alias("shortfall"),
    )


def growth_report(prev: DataFrame, new_train: DataFrame, new_val: DataFrame, class_col: str) -> DataFrame:
    """Per class: previous, new train, new val, total (full outer joins of counts)."""
    def cnt(d, name):
        return d.groupBy(class_col).agg(F.count(F.lit(1)).alias(name))

    j = cnt(prev, "previous").join(cnt(new_train, "new_train"), class_col, "full").join(cnt(new_val, "new_val"), class_col, "full")
    j = j.select(class_col, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("previous", "new_train", "new_val")])
    return j.withColumn("total", F.col("previous") + F.col("new_train") + F.col("new_val"))


def union_with_provenance(parts: dict[str, DataFrame]) -> DataFrame:
    """Union by name with a ``provenance`` column naming the part."""
    out = None
    for name, d in parts.items():
        d = d.withColumn("provenance", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def manifest(df: DataFrame, source: str = "source") -> DataFrame:
    """A10: rows per source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))


# ----------------------------------------------------------------- validation

def validate_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One pass; ``reasons`` lists the failed checks, ``is_valid`` when none."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def request_checks() -> dict[str, Column]:
    """The rules of profile and log requests; a missing value fails its rule, but notes are optional."""
    return {
        "user_id_length": F.length("user_id").between(3, 32), "username_length": F.length("username").between(1, 50), "unknown_build": F.lower("build").isin(*K.BUILDS),
        "duration_range": F.col("duration_minutes").between(*K.DURATION_MINUTES), "unknown_intensity": F.lower("intensity").isin(*[n for n, _ in K.INTENSITY]),
        "notes_length": F.coalesce(F.length("notes"), F.lit(0)) <= 200,
    }


def feature_checks() -> dict[str, Column]:
    """User-day features are not negative, and rates are between 0 and 1."""
    counts = ("activities_per_day", "daily_xp_total", "streak_gap_days", "avg_session_duration", "max_session_duration", "xp_per_minute")
    return {c: F.col(c) >= 0 for c in counts} | {c: F.col(c).between(0.0, 1.0) for c in ("intensity_switch_rate", "sessions_at_cap_ratio")}


def hash_class(key, classes: list[str] = KW.CLASS_ORDER, seed: int = 42) -> Column:
    """A deterministic stand-in for a random class: md5(seed:key) -> one
    of ``classes`` (first 8 hex digits mod the number of classes)."""
    h = F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (F.pmod(h, F.lit(len(classes))) + 1).cast("int"))


def append_bio(system, bio) -> Column:
    """The system text, a space, and the optional biography behind its lead; stripped."""
    b = T.py_strip(T.nz(bio))
    lead = F.when(b != "", F.concat(F.lit(T.BIO_LEAD), b)).otherwise(F.lit(""))
    return T.py_strip(F.concat(T.nz(system), F.lit(" "), lead))


def training_rows(df: DataFrame, class_col: str, classes: list[str] | None, max_samples: int | None, order: list[str]) -> DataFrame:
    """Keep the wanted classes and complete rows (user and assistant
    present), then at most ``max_samples`` rows in ``order``."""
    d = df.where(F.col("user").isNotNull() & (F.col("user") != "") & F.col("assistant").isNotNull() & (F.col("assistant") != ""))
    if classes:
        d = d.where(F.col(class_col).isin(*classes))
    return first_n_per_group(d, [], order, max_samples) if max_samples else d


def sequential_dedup_quota(
    df: DataFrame, source_col: str, sources: list[str], key: Column, class_col: str, cap: int, order: list[str],
) -> DataFrame:
    """E3 x E4 in their sequential form: sources are taken in the given order;
    within a source a row is skipped if an earlier source already accepted its
    key or an earlier row of this source holds the key, and then at most
    ``cap`` rows per class are accepted. A row turned away by a full quota
    does not claim its key, so a later source may still take it (first-wins
    dedup runs only among rows of the same source).

    ``sources`` is a parameter (the collectors' order), so the loop composes a
    plan per source; accepted keys are checkpointed each step."""
    d = df.withColumn("_key", key)
    accepted = None
    keys = None
    for src in sources:
        part = d.where(F.col(source_col) == src)
        if keys is not None:
            part = part.join(keys, "_key", "left_anti")
        first = dedup_first_wins(part, [], F.col("_key"), order)
        take = quota(first, [class_col], order, cap)
        accepted = take if accepted is None else accepted.unionByName(take)
        new_keys = take.select("_key")
        keys = (new_keys if keys is None else keys.unionByName(new_keys)).checkpoint(eager=True)
    if accepted is None:
        return df.limit(0)
    return accepted.drop("_key")
