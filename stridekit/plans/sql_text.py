"""SQL renderings of the text expressions for the DuckDB oracle."""

from __future__ import annotations

from ..functions import keywords as KW
from ..functions import text as T


#: The entities of the queries' texts; "&amp;" last, as one pass would have it.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&Eacute;t", "\u00c9t"), ("&notit;", "\u00acit;"), ("&#x1F600;", "\U0001f600"), ("&amp;", "&")]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nz(x: str) -> str:
    return f"coalesce({x}, '')"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def clean_text(x: str) -> str:
    t = f"replace(translate({nz(x)}, {q(T.SMART_FROM)}, {q(T.SMART_TO)}), {q(T.ELLIPSIS[0])}, {q(T.ELLIPSIS[1])})"
    return py_strip(f"regexp_replace({t}, '{T.WS}+', ' ', 'g')")


def clean_post(x: str) -> str:
    raw = nz(x)
    t = raw
    for ent, ch in ENTITIES:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    t = f"regexp_replace({t}, 'http{T.NON_WS}+', '', 'g')"
    t = rf"regexp_replace({t}, '\*{{1,3}}(.*?)\*{{1,3}}', '\1', 'g')"
    t = rf"regexp_replace({t}, '(?m)^>[^\n]*\n?', '', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    t = py_strip(t)
    sentinels = ", ".join(q(s) for s in T.EMPTY_SENTINELS)
    return f"(CASE WHEN {py_strip(raw)} IN ({sentinels}) THEN '' ELSE {t} END)"


def strip_quotes(x: str) -> str:
    return py_strip(f"regexp_replace({py_strip(x)}, '^\"+|\"+$', '', 'g')")


def cut_at_word(x: str, limit: int = 800, suffix: str = "...") -> str:
    t = nz(x)
    head = f"substr({t}, 1, {limit})"
    cut = f"(CASE WHEN strpos({head}, ' ') > 0 THEN regexp_extract({head}, '(?s)^(.*) ', 1) ELSE {head} END)"
    return f"(CASE WHEN length({t}) > {limit} THEN {cut} || {q(suffix)} ELSE {t} END)"


def count_present(lower: str, kws: list[str], mode: str = "substring") -> str:
    if not kws:
        return "0"
    if mode == "word":
        parts = [f"(CASE WHEN regexp_matches({lower}, {q(KW.word_pattern(k))}) THEN 1 ELSE 0 END)" for k in kws]
    else:
        parts = [f"(CASE WHEN contains({lower}, {q(k)}) THEN 1 ELSE 0 END)" for k in kws]
    return "(" + " + ".join(parts) + ")"


def any_present(lower: str, kws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({lower}, {q(k)})" for k in kws) + ")"


def class_score_cols(text: str, table) -> dict[str, str]:
    lower = f"lower({text})"
    by: dict[str, dict[int, list[str]]] = {}
    for c, w, k in table:
        by.setdefault(c, {}).setdefault(w, []).append(k)
    out = {}
    for c, groups in by.items():
        out[c] = "CAST(" + " + ".join(f"{count_present(lower, kws)} * {w}" for w, kws in groups.items()) + " AS INTEGER)"
    return out


def best_class(score_cols: dict[str, str], order=KW.CLASS_ORDER, min_score: int = KW.MIN_CLASS_SCORE) -> str:
    cls = [c for c in order if c in score_cols]
    g = "greatest(" + ", ".join(score_cols[c] for c in cls) + ")"
    whens = " ".join(f"WHEN {score_cols[c]} = {g} THEN {q(c)}" for c in cls)
    return f"(CASE WHEN {g} < {min_score} THEN NULL ELSE (CASE {whens} END) END)"


def lexicon_hits(text: str) -> tuple[str, str]:
    lower = f"lower({text})"
    s = f"({count_present(lower, KW.STRUGGLING_PHRASES)} + {count_present(lower, KW.STRUGGLING_WORDS, 'word')})"
    m = f"({count_present(lower, KW.MOTIVATED_PHRASES)} + {count_present(lower, KW.MOTIVATED_WORDS, 'word')})"
    return s, m


def route_message(msg: str, sentiment: str | None = None) -> str:
    lower = f"lower({msg})"
    mot = any_present(lower, KW.MOTIVATION_KEYWORDS)
    if sentiment:
        mot = f"(coalesce({sentiment}, '') = 'struggling' OR {mot})"
    return (
        f"(CASE WHEN {mot} THEN 'motivation' WHEN {any_present(lower, KW.BUILD_KEYWORDS)} THEN 'build_advisor' "
        f"WHEN {any_present(lower, KW.XP_KEYWORDS)} THEN 'xp_coach' ELSE 'general' END)"
    )


def shuffle_key(seed, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"
