"""Text column expressions (JVM-side regex/string functions only).

Whitespace: Python's ``str.strip``/``\\s`` use the Unicode whitespace set,
Java and RE2 use ASCII by default, so the set is spelled out (``WS``) and the
same class is used by the SQL oracle.
"""

from __future__ import annotations

import html

import pandas as pd
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------- FIXED VALUES
# Unicode whitespace as in Python's str.isspace().
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = r"[^\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Smart punctuation to ASCII (one character to one character), then the ellipsis.
SMART_FROM = "‘’“”—–éà"
SMART_TO = "''\"\"--ea"
ELLIPSIS = ("…", "...")

# Values that mean "no text" in raw posts.
EMPTY_SENTINELS = ["[deleted]", "[removed]", "null", "None"]

# Chat markup tokens.
INST_CLOSE = "[/INST]"
SYS_CLOSE = "<</SYS>>"
MARKUP_DROP_Q = ["<s>", "[INST]"]
MARKUP_DROP_A = ["</s>"]

# Delimited transcripts and problem/solution templates.
EOM = "|EOM|"
EOM_PATTERN = r"\|EOM\|"
TEACHER_PREFIX = "teacher:"
MATH_PREFIX = "Math problem: "
STUDENT_PREFIX = "\n\nStudent: "
SOLVE_Q = "Can you help me solve this math problem? "
SOLVE_A = "Sure! Let me walk you through this step by step.\n\n"
BIO_LEAD = "Speak in the style of this character: "
CUSTOMER_MARK = "Customer:"
AGENT_MARK = "Salesman:"
# ------------------------------------------------------------ END FIXED VALUES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: The characters of ``WS``.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_c(x), F.lit(_SPACES))  # reads the ends alone, where a regex tries every place of the text


def nz(x) -> Column:
    """Missing string -> ''."""
    return F.coalesce(_c(x), F.lit(""))


def clean_text(x) -> Column:
    """Smart punctuation to ASCII, whitespace runs to one space, stripped."""
    t = F.translate(nz(x), SMART_FROM, SMART_TO)
    t = F.replace(t, F.lit(ELLIPSIS[0]), F.lit(ELLIPSIS[1]))
    return py_strip(F.regexp_replace(t, f"{WS}+", " "))


def html_unescape(x) -> Column:
    """HTML entities, named with or without ``;`` by the longest known name, and numeric ones, as HTML 5 has them.

    Texts without an ampersand do not leave the JVM's column: only the others go to Python, in Arrow batches.
    """
    t = _c(x)
    has = F.contains(t, F.lit("&"))
    return F.coalesce(_decoded(F.when(has, t)), t)


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_post(x) -> Column:
    """Sentinel -> ''; entities; URLs out; *emphasis* unwrapped; lines that
    start with ``>`` (quotes) out; 3+ newlines -> 2; stripped."""
    raw = nz(x)
    t = html_unescape(raw)
    t = F.regexp_replace(t, f"http{NON_WS}+", "")
    t = F.regexp_replace(t, r"\*{1,3}(.*?)\*{1,3}", "$1")
    t = F.regexp_replace(t, r"(?m)^>[^\n]*\n?", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = py_strip(t)
    return F.when(py_strip(raw).isin(*EMPTY_SENTINELS), F.lit("")).otherwise(t)


def strip_quotes(x) -> Column:
    """Strip whitespace, then '"', then whitespace."""
    return py_strip(F.regexp_replace(py_strip(x), '^"+|"+$', ""))


def prefix(x, n: int) -> Column:
    """C4: first n characters."""
    return F.substring(nz(x), 1, n)


def cut_at_word(x, limit: int = 800, suffix: str = "...") -> Column:
    """Longer than ``limit`` -> first ``limit`` characters cut back to the
    last space (kept whole if it has none), plus the suffix."""
    t = nz(x)
    head = F.substring(t, 1, limit)
    before_space = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    has_space = F.instr(head, " ") > 0
    cut = F.when(has_space, before_space).otherwise(head)
    return F.when(F.length(t) > limit, F.concat(cut, F.lit(suffix))).otherwise(t)


def first_nonempty(*cols) -> Column:
    """B2: first column whose stripped value is not empty; '' if none."""
    return F.coalesce(*[F.when(py_strip(nz(c)) != "", py_strip(nz(c))) for c in cols], F.lit(""))


def merge_instruction(instruction, inp, sep: str = "\n") -> Column:
    """Instruction plus optional input."""
    i, x = py_strip(nz(instruction)), py_strip(nz(inp))
    return F.when(x != "", F.concat(i, F.lit(sep), x)).otherwise(i)


def sanitize_key(x) -> Column:
    """Keep letters, digits, '-' and '_'."""
    return F.regexp_replace(nz(x), r"[^\p{L}\p{N}_-]", "")


def split_chat_markup(x) -> tuple[Column, Column]:
    """(question, answer) around the first ``[/INST]``; the question drops
    the system block and tags. NULLs when the marker is missing."""
    t = py_strip(nz(x))
    pos = F.instr(t, INST_CLOSE)
    q_raw = F.substring(t, F.lit(1), pos - 1)
    a_raw = F.substring(t, pos + len(INST_CLOSE), F.length(t))
    sys_pos = F.instr(q_raw, SYS_CLOSE)
    q_raw = F.when(sys_pos > 0, F.substring(q_raw, sys_pos + len(SYS_CLOSE), F.length(q_raw))).otherwise(q_raw)
    for tok in MARKUP_DROP_Q:
        q_raw = F.replace(q_raw, F.lit(tok), F.lit(""))
    for tok in MARKUP_DROP_A:
        a_raw = F.replace(a_raw, F.lit(tok), F.lit(""))
    has = pos > 0
    return F.when(has, py_strip(q_raw)), F.when(has, py_strip(a_raw))
