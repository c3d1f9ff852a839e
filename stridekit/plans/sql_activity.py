"""DuckDB oracle SQL for the activity queries.

The oracle is written independently of the Spark plans: streaks and the XP
ledger are sequential state machines (recursive CTEs stepping one day / one
event at a time per user), exactly as the rules are stated. Only the fixed
values are shared, rendered from ``constants``.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources.tables import activity_log_sql


def rel_values() -> str:
    rows = []
    for name, scores in K.RELEVANCE:
        for b, s in zip(K.BUILDS, scores):
            rows.append(f"('{name}', '{b}', CAST({s} AS DOUBLE))")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(activity_type, build, score)"


def intensity_values() -> str:
    rows = ", ".join(f"('{n}', CAST({v} AS DOUBLE))" for n, v in K.INTENSITY)
    return f"SELECT * FROM (VALUES {rows}) t(intensity, mult)"


def level_sql(t: str) -> str:
    return (
        f"(CASE WHEN {t} < 5000 THEN greatest(1, {t} // 500 + 1) "
        f"WHEN {t} < 20000 THEN 10 + ({t} - 5000) // 1500 ELSE 20 + ({t} - 20000) // 3000 END)"
    )


def cap_sql(level: str) -> str:
    parts = " ".join(f"WHEN {level} >= {lv} THEN {cap}" for lv, cap in K.DAILY_CAP_TIERS)
    return f"(CASE {parts} ELSE 600 END)"


def streak_mult_sql(s: str) -> str:
    parts = " ".join(f"WHEN {s} >= {d} THEN CAST({m} AS DOUBLE)" for d, m, _ in K.STREAK_MILESTONES)
    return f"(CASE {parts} ELSE CAST(1.0 AS DOUBLE) END)"


def milestone_sql(s: str) -> str:
    parts = " ".join(f"WHEN {s} = {d} THEN '{n}'" for d, _, n in K.STREAK_MILESTONES)
    return f"(CASE {parts} END)"


def badge_index_sql(t: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN {t} >= {th} THEN 1 ELSE 0 END)" for th in K.BADGE_THRESHOLDS) + " - 1)"


def badge_name_sql(build: str, idx: str) -> str:
    parts = []
    for b, names in K.BADGE_NAMES.items():
        for i, n in enumerate(names):
            parts.append(f"WHEN {build} = '{b}' AND {idx} = {i} THEN '{n}'")
    return "(CASE " + " ".join(parts) + " END)"


def _dims() -> str:
    return f"""
    al AS ({activity_log_sql()}),
    rel AS ({rel_values()}),
    im AS ({intensity_values()})"""


def _common() -> str:
    return _dims() + f""",
    d AS (
      SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn
      FROM (SELECT DISTINCT user_id, day FROM al)
    ),
    s AS (
      SELECT user_id, rn, day, 1 AS streak, 1 AS longest, {K.SHIELDS_PER_MONTH} AS shields,
             date_trunc('month', day) AS mon, false AS broken, false AS shield_used
      FROM d WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, day, new_streak, greatest(longest, new_streak),
             CASE WHEN use_shield THEN sh - 1 ELSE sh END, mon,
             (g <> 1 AND NOT use_shield), use_shield
      FROM (
        SELECT user_id, rn, day, longest, mon, g, sh, use_shield,
               CASE WHEN g = 1 OR use_shield THEN streak + 1 ELSE 1 END AS new_streak
        FROM (
          SELECT n.user_id, n.rn, n.day, p.longest, p.streak, date_trunc('month', n.day) AS mon,
                 date_diff('day', p.day, n.day) AS g,
                 CASE WHEN date_trunc('month', n.day) <> p.mon THEN {K.SHIELDS_PER_MONTH} ELSE p.shields END AS sh,
                 date_diff('day', p.day, n.day) = 2
                   AND (CASE WHEN date_trunc('month', n.day) <> p.mon THEN {K.SHIELDS_PER_MONTH} ELSE p.shields END) > 0 AS use_shield
          FROM s p JOIN d n ON n.user_id = p.user_id AND n.rn = p.rn + 1
        )
      )
    )"""


def daily_raw_xp_sql() -> str:
    return f"""
    WITH {_dims()}
    SELECT user_id, day, count(*) AS sessions, CAST(sum(duration_minutes) AS BIGINT) AS minutes,
           CAST(sum(xp) AS BIGINT) AS raw_xp, CAST(sum(CASE WHEN prim THEN xp ELSE 0 END) AS BIGINT) AS primary_xp
    FROM (
      SELECT al.user_id, al.day, al.duration_minutes, coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD} AS prim,
             CAST(round_even(CAST(al.duration_minutes AS DOUBLE) * im.mult
                  * (CASE WHEN coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)
                  * CAST(1.0 AS DOUBLE), 0) AS INTEGER) AS xp
      FROM al LEFT JOIN rel ON rel.activity_type = al.activity_type AND rel.build = al.build
              LEFT JOIN im ON im.intensity = al.intensity
    )
    GROUP BY user_id, day"""


def streaks_sql() -> str:
    return f"""
    WITH RECURSIVE {_common()}
    SELECT user_id, day, CAST(streak AS INTEGER) AS current_streak, CAST(longest AS INTEGER) AS longest_streak,
           shield_used, broken AS streak_broken, CAST(shields AS INTEGER) AS shields_remaining
    FROM s"""


def ledger_sql(with_ts: bool = False) -> str:
    t = "f.total"
    return f"""
    WITH RECURSIVE {_common()},
    e AS (
      SELECT al.*, s.streak, s.longest, s.shields, s.broken, s.shield_used AS shield,
             coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD} AS is_primary,
             CASE WHEN coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS rmult,
             im.mult AS imult, {streak_mult_sql('s.streak')} AS smult,
             row_number() OVER (PARTITION BY al.user_id ORDER BY al.ts, al.event_id) AS n,
             row_number() OVER (PARTITION BY al.user_id, al.day ORDER BY al.ts, al.event_id) AS n_today
      FROM al JOIN s ON s.user_id = al.user_id AND s.day = al.day
              LEFT JOIN rel ON rel.activity_type = al.activity_type AND rel.build = al.build
              LEFT JOIN im ON im.intensity = al.intensity
    ),
    e2 AS (
      SELECT *, CAST(duration_minutes AS DOUBLE) * imult * rmult * smult AS raw_xp,
             CAST(round_even(CAST(duration_minutes AS DOUBLE) * imult * rmult * smult, 0) AS INTEGER) AS rr
      FROM e
    ),
    f AS (
      SELECT user_id, n, day, CAST(0 AS BIGINT) AS t_before, 0 AS d_before, 600 AS cap,
             least(rr, 600) AS earned, CAST(least(rr, 600) AS BIGINT) AS total, least(rr, 600) AS daily
      FROM e2 WHERE n = 1
      UNION ALL
      SELECT user_id, n, day, t_before, d_before, cap, earned, t_before + earned, d_before + earned
      FROM (
        SELECT user_id, n, day, t_before, d_before, cap, least(rr, greatest(0, cap - d_before)) AS earned
        FROM (
          SELECT x.user_id, x.n, x.day, x.rr, {t} AS t_before,
                 CASE WHEN x.day = f.day THEN f.daily ELSE 0 END AS d_before,
                 {cap_sql(level_sql(t))} AS cap
          FROM f JOIN e2 x ON x.user_id = f.user_id AND x.n = f.n + 1
        )
      )
    ),
    j AS (
      SELECT e2.*, f.t_before, f.d_before, f.cap, f.earned, f.total,
             {milestone_sql('e2.streak')} AS power_up_name,
             CASE WHEN {badge_index_sql('f.total')} > {badge_index_sql('f.t_before')}
                  THEN {badge_name_sql('e2.build', badge_index_sql('f.total'))} END AS badge_earned
      FROM e2 JOIN f ON f.user_id = e2.user_id AND f.n = e2.n
    )
    SELECT user_id, event_id, {"ts, " if with_ts else ""}day, activity_type, duration_minutes, intensity, build,
           CAST(duration_minutes AS DOUBLE) AS base_xp, imult AS intensity_mult, rmult AS relevance_mult,
           smult AS streak_mult, raw_xp, CAST(earned AS INTEGER) AS final_xp,
           rr > greatest(0, cap - d_before) AS was_capped,
           CAST(d_before AS INTEGER) AS daily_xp_before, CAST(d_before + earned AS INTEGER) AS daily_xp_after,
           CAST(cap AS INTEGER) AS daily_cap, CAST(greatest(0, cap - d_before) - earned AS INTEGER) AS daily_xp_remaining,
           is_primary, power_up_name, CAST(streak AS INTEGER) AS current_streak, CAST(longest AS INTEGER) AS longest_streak,
           (shield AND n_today = 1) AS shield_used, (broken AND n_today = 1) AS streak_broken,
           CAST(shields AS INTEGER) AS shields_remaining, CAST(n_today AS INTEGER) AS n_today,
           CAST(t_before AS BIGINT) AS total_xp_before, CAST(total AS BIGINT) AS total_xp_after,
           CAST({level_sql('total')} AS INTEGER) AS level_after, badge_earned,
           CASE WHEN broken AND n_today = 1 THEN 'support_mode'
                WHEN badge_earned IS NOT NULL OR power_up_name IS NOT NULL THEN 'hype_mode' END AS chatbot_hint
    FROM j"""


def _builds_list() -> str:
    return "[" + ", ".join(f"'{b}'" for b in K.BUILDS) + "]"


def next_level_sql(t: str) -> str:
    nl = f"({level_sql(t)} + 1)"
    return f"(CASE WHEN {nl} <= 10 THEN ({nl} - 1) * 500 WHEN {nl} <= 20 THEN ({nl} - 10) * 1500 + 5000 ELSE ({nl} - 20) * 3000 + 20000 END)"


def snapshot_sql() -> str:
    th = "[" + ", ".join(str(x) for x in K.BADGE_THRESHOLDS) + "]"
    idx = badge_index_sql("total_xp_after")
    cap = cap_sql(level_sql("total_xp_after"))
    return f"""
    WITH led AS ({ledger_sql(with_ts=True)}),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk,
             count(*) OVER (PARTITION BY user_id) AS cnt
      FROM led
    )
    SELECT user_id, build AS primary_build, total_xp_after AS total_xp,
           CAST({level_sql('total_xp_after')} AS INTEGER) AS level,
           coalesce({badge_name_sql('build', idx)}, 'Unranked') AS badge,
           {badge_name_sql('build', idx + ' + 1')} AS next_badge,
           CAST(CASE WHEN {idx} + 1 < {len(K.BADGE_THRESHOLDS)} THEN greatest(0, {th}[{idx} + 2] - total_xp_after) END AS INTEGER) AS xp_to_next_badge,
           CAST({next_level_sql('total_xp_after')} - total_xp_after AS INTEGER) AS xp_to_next_level,
           {idx} >= {K.LEGENDARY_BADGE_INDEX} AS is_legendary,
           current_streak, longest_streak, {streak_mult_sql('current_streak')} AS streak_multiplier,
           shields_remaining, day AS last_activity_date, daily_xp_after AS daily_xp_today,
           CAST({cap} AS INTEGER) AS daily_xp_cap,
           CAST(greatest(0, {cap} - daily_xp_after) AS INTEGER) AS daily_xp_remaining,
           daily_xp_after >= {cap} AS daily_cap_reached, cnt AS total_activities
    FROM r WHERE rk = 1"""


def recent_logs_sql(n: int = 5) -> str:
    return f"""
    WITH led AS ({ledger_sql(with_ts=True)})
    SELECT user_id, recent_rank, activity, duration, intensity, xp, logged_at FROM (
      SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS recent_rank,
             activity_type AS activity, duration_minutes AS duration, intensity, final_xp AS xp,
             strftime(ts, '%Y-%m-%dT%H:%M:%S') AS logged_at
      FROM led
    ) WHERE recent_rank <= {n}"""


def best_activities_sql(duration: int = 60, top: int = 10) -> str:
    acts = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(K.RELEVANCE))
    return f"""
    WITH snap AS ({snapshot_sql()}),
    rel AS ({rel_values()}),
    cat AS (SELECT * FROM (VALUES {acts}) t(table_order, activity_type)),
    x AS (
      SELECT snap.user_id, cat.table_order, cat.activity_type,
             CAST(least(CAST(round_even(CAST({duration} AS DOUBLE) * CAST(2.0 AS DOUBLE)
                   * (CASE WHEN coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)
                   * {streak_mult_sql('snap.current_streak')}, 0) AS INTEGER),
                   greatest(0, snap.daily_xp_cap - snap.daily_xp_today)) AS INTEGER) AS projected_xp
      FROM snap CROSS JOIN cat
      LEFT JOIN rel ON rel.activity_type = cat.activity_type AND rel.build = snap.primary_build
    )
    SELECT user_id, rank, activity_type, projected_xp FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY projected_xp DESC, table_order) AS INTEGER) AS rank FROM x
    ) WHERE rank <= {top}"""


def preview_sql() -> str:
    prim = f"coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD}"
    rm = f"(CASE WHEN {prim} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)"
    raw = f"(CAST(p.duration_minutes AS DOUBLE) * im.mult * {rm} * {streak_mult_sql('snap.current_streak')})"
    rem = "greatest(0, snap.daily_xp_cap - snap.daily_xp_today)"
    return f"""
    WITH snap AS ({snapshot_sql()}),
    {_dims()},
    p AS (SELECT user_id, event_id, activity_type, duration_minutes, intensity FROM al)
    SELECT p.user_id, p.event_id, p.activity_type, p.duration_minutes, p.intensity,
           CAST(least(CAST(round_even({raw}, 0) AS INTEGER), {rem}) AS INTEGER) AS projected_xp,
           im.mult AS intensity_mult, {rm} AS relevance_mult, {streak_mult_sql('snap.current_streak')} AS streak_mult,
           round_even({raw}, 1) AS raw_xp, {prim} AS is_primary,
           CAST(round_even({raw}, 0) AS INTEGER) > {rem} AS would_cap, CAST({rem} AS INTEGER) AS daily_remaining
    FROM p JOIN snap ON snap.user_id = p.user_id
    LEFT JOIN rel ON rel.activity_type = p.activity_type AND rel.build = snap.primary_build
    LEFT JOIN im ON im.intensity = p.intensity"""


def switch_sql() -> str:
    legendary = K.BADGE_THRESHOLDS[K.LEGENDARY_BADGE_INDEX]
    return f"""
    WITH snap AS (
      SELECT user_id, primary_build, total_xp * 40 AS total_xp, total_xp * 40 >= {legendary} AS is_legendary,
             CASE WHEN user_id % 3 = 0 THEN {_builds_list()}[CAST((user_id + 2) % 7 AS INTEGER) + 1] END AS slot
      FROM ({snapshot_sql()})),
    req AS (
      SELECT user_id, {_builds_list()}[CAST((user_id + 1) % 7 AS INTEGER) + 1] AS new_build,
             CASE WHEN user_id % 2 = 0 THEN 'archive' ELSE 'secondary' END AS mode
      FROM snap
    ),
    x AS (SELECT req.*, snap.* EXCLUDE (user_id), is_legendary AND NOT (mode = 'secondary' AND slot IS NOT NULL) AS ok
          FROM req JOIN snap ON snap.user_id = req.user_id)
    SELECT user_id, mode, lower(new_build) AS new_build, ok AS success,
           CASE WHEN NOT is_legendary THEN 'Must reach Legendary badge first.'
                WHEN mode = 'secondary' AND slot IS NOT NULL THEN 'Secondary build slot already active.' END AS reason,
           CASE WHEN ok AND mode = 'archive' THEN lower(new_build) ELSE primary_build END AS primary_build,
           CASE WHEN ok AND mode = 'archive' THEN CAST({K.LEGACY_BONUS_XP} AS BIGINT) ELSE total_xp END AS primary_total_xp,
           CASE WHEN ok AND mode = 'archive' THEN primary_build END AS archived_build,
           CASE WHEN ok AND mode = 'archive' THEN total_xp END AS archived_total_xp,
           CASE WHEN ok AND mode = 'secondary' THEN lower(new_build) ELSE slot END AS secondary_build
    FROM x"""


def gamer_sql() -> str:
    prim = f"coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD}"
    lvl = level_sql("led.total_xp_before")
    boss = f"(led.current_streak > 0 AND led.current_streak % {K.GAMER_BOSS_DAY_INTERVAL} = 0)"
    base_cap = cap_sql(lvl)
    combo_next = "(sessions_before + 1)"
    combo_parts = " ".join(f"WHEN {combo_next} = {k} THEN CAST({v} AS DOUBLE)" for k, v in K.GAMER_COMBO)
    return f"""
    WITH led AS ({ledger_sql(with_ts=True)}),
    rel AS ({rel_values()}),
    g AS (
      SELECT led.*, {prim} AS prim, CAST({lvl} AS INTEGER) AS current_level, {boss} AS boss,
             {base_cap} AS base_cap,
             CASE WHEN {boss} THEN {base_cap} * 2 ELSE {base_cap} END AS eff_cap,
             CAST(round_even(CAST(led.duration_minutes AS DOUBLE) * led.intensity_mult
                  * (CASE WHEN {prim} THEN CAST(1.0 AS DOUBLE) ELSE CAST({K.GAMER_SIDE_QUEST_MULT} AS DOUBLE) END)
                  * led.streak_mult, 0) AS INTEGER) AS rounded
      FROM led LEFT JOIN rel ON rel.activity_type = led.activity_type AND rel.build = 'gamer'
      WHERE led.build = 'gamer'
    ),
    g2 AS (
      SELECT *, greatest(0, eff_cap - daily_xp_before) AS rem,
             CASE WHEN prim THEN greatest(0, rounded - greatest(0, eff_cap - daily_xp_before)) ELSE 0 END AS over
      FROM g
    ),
    g3 AS (
      SELECT *,
             CAST(coalesce(sum(CASE WHEN prim THEN 1 ELSE 0 END) OVER w, 0) AS INTEGER) AS sessions_before,
             CAST(least({K.GAMER_OVERTIME_LIMIT}, coalesce(sum(over) OVER w, 0)) AS INTEGER) AS ot_before,
             least(rounded, rem) AS earned
      FROM g2
      WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    g4 AS (
      SELECT *,
             CASE WHEN NOT prim THEN CAST(0.0 AS DOUBLE) WHEN {combo_next} <= 1 THEN CAST(0.0 AS DOUBLE) {combo_parts}
                  ELSE CAST({K.GAMER_COMBO_MAX} AS DOUBLE) END AS combo,
             CASE WHEN prim AND intensity = 'intense' AND duration_minutes <= {K.GAMER_SPEEDRUN_MAX_MINUTES} THEN {K.GAMER_SPEEDRUN_BONUS} ELSE 0 END AS speed,
             CASE WHEN prim AND (daily_xp_before + least(rounded, rem) >= eff_cap OR daily_xp_before >= eff_cap)
                  THEN least(greatest(0, rounded - rem), greatest(0, {K.GAMER_OVERTIME_LIMIT} - ot_before)) ELSE 0 END AS ot
      FROM g3
    )
    SELECT user_id, event_id, day, activity_type, duration_minutes, intensity, current_streak, current_level,
           daily_xp_before AS daily_xp_so_far, sessions_before AS primary_sessions_today, ot_before AS overtime_xp_today,
           CAST(earned AS INTEGER) AS base_final_xp, combo AS combo_multiplier,
           CAST(floor(earned * combo) AS INTEGER) AS combo_bonus_xp, boss AS is_boss_day,
           (boss AND daily_xp_before > base_cap) AS boss_day_cap_used, CAST(speed AS INTEGER) AS speedrun_bonus,
           CAST(ot AS INTEGER) AS overtime_xp, NOT prim AS side_quest_penalty,
           CAST(floor(earned * combo) + speed + ot AS INTEGER) AS gamer_bonus_total,
           CAST(earned + floor(earned * combo) + speed + ot AS INTEGER) AS gamer_final_xp,
           CAST(greatest(0, {K.GAMER_OVERTIME_LIMIT} - ot_before - ot) AS INTEGER) AS overtime_pool_remaining
    FROM g4"""


def late_ledger_sql(every: int, days: int, batch_days: int) -> str:
    """Every user's events in order of arrival (micro-batch, then time), one step an event; late ones leave the streak alone."""
    late = f"(CASE WHEN event_id % {every} = 3 THEN 1 + event_id % {days} ELSE 0 END)"
    return f"""
    WITH RECURSIVE {_dims()},
    a AS (
      SELECT al.*, CAST(al.duration_minutes AS DOUBLE) * im.mult
               * (CASE WHEN coalesce(rel.score, 0.5) >= {K.PRIMARY_THRESHOLD} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END) AS base,
             (date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), al.day) + {late}) // {batch_days} AS batch
      FROM al LEFT JOIN rel ON rel.activity_type = al.activity_type AND rel.build = al.build LEFT JOIN im ON im.intensity = al.intensity
    ),
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch, ts, event_id) AS n FROM a),
    f AS (
      SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DATE) AS day, '' AS build, CAST(NULL AS DATE) AS last, 0 AS streak, 0 AS longest,
             CAST(NULL AS DATE) AS mon, 0 AS used, CAST(0 AS BIGINT) AS total, MAP {{CAST('1900-01-01' AS DATE): CAST(0 AS BIGINT)}} AS pools,
             CAST(0 AS BIGINT) AS rr, CAST(0 AS BIGINT) AS d_before, 600 AS cap, CAST(0 AS BIGINT) AS earned, false AS shield, false AS broken
      FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, n, event_id, day, build, last2, streak2, greatest(longest, streak2), mon2, used2, total + earned, map_concat(pools, MAP {{day: d_before + earned}}),
             rr, d_before, cap, earned, shield, broken
      FROM (
        SELECT *, least(rr, greatest(0, cap - d_before)) AS earned
        FROM (
          SELECT *, CAST(round_even(base * {streak_mult_sql('streak2')}, 0) AS BIGINT) AS rr, coalesce(pools[day], 0) AS d_before, {cap_sql(level_sql('total'))} AS cap
          FROM (
            SELECT *, CASE WHEN late OR g = 0 THEN streak WHEN g IS NULL OR broken THEN 1 ELSE streak + 1 END AS streak2,
                   CASE WHEN late THEN used ELSE u + CAST(shield AS INTEGER) END AS used2,
                   CASE WHEN late THEN mon ELSE date_trunc('month', day) END AS mon2, CASE WHEN late THEN last ELSE day END AS last2
            FROM (
              SELECT *, coalesce(g >= 2, false) AND NOT shield AS broken
              FROM (
                SELECT *, coalesce(g < 0, false) AS late, coalesce(g = 2, false) AND u < {K.SHIELDS_PER_MONTH} AS shield
                FROM (
                  SELECT f.user_id, e.n, e.event_id, e.day, e.build, e.base, f.last, f.streak, f.longest, f.mon, f.used, f.total, f.pools,
                         date_diff('day', f.last, e.day) AS g, CASE WHEN f.mon = date_trunc('month', e.day) THEN f.used ELSE 0 END AS u
                  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1
                )
              )
            )
          )
        )
      )
    ),
    j AS (
      SELECT *, total - earned AS t_before, {milestone_sql('streak')} AS milestone,
             CASE WHEN {badge_index_sql('total')} > {badge_index_sql('(total - earned)')} THEN {badge_name_sql('build', badge_index_sql('total'))} END AS badge_earned
      FROM f WHERE n > 0
    )
    SELECT user_id, event_id, day, CAST(earned AS INTEGER) AS final_xp, rr > greatest(0, cap - d_before) AS was_capped, CAST(d_before AS INTEGER) AS daily_xp_before,
           CAST(d_before + earned AS INTEGER) AS daily_xp_after, CAST(cap AS INTEGER) AS daily_cap, CAST(streak AS INTEGER) AS current_streak,
           CAST(longest AS INTEGER) AS longest_streak, shield AS shield_used, broken AS streak_broken, CAST({K.SHIELDS_PER_MONTH} - used AS INTEGER) AS shields_remaining,
           t_before AS total_xp_before, total AS total_xp_after, CAST({level_sql('total')} AS INTEGER) AS level_after, badge_earned,
           CASE WHEN broken THEN 'support_mode' WHEN badge_earned IS NOT NULL OR milestone IS NOT NULL THEN 'hype_mode' END AS chatbot_hint
    FROM j"""
