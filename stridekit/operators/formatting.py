"""Prompt and conversation formatting (I1-I5) as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scan import first_rows

# ---------------------------------------------------------------- FIXED VALUES
BOS = "<|begin_of_text|>"
EOT = "<|eot_id|>"
HDR_START = "<|start_header_id|>"
HDR_END = "<|end_header_id|>"
REQUIRED_MARKERS = [BOS, EOT, HDR_START, HDR_END]
# ------------------------------------------------------------ END FIXED VALUES


def header(role) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(HDR_START), r, F.lit(HDR_END + "\n\n"))


def training_text(system, user, assistant) -> Column:
    """Begin token + system/user/assistant sections, each closed by EOT."""
    return F.concat(
        F.lit(BOS),
        header("system"), T.py_strip(T.nz(system)), F.lit(EOT),
        header("user"), T.py_strip(T.nz(user)), F.lit(EOT),
        header("assistant"), T.py_strip(T.nz(assistant)), F.lit(EOT),
    )


def inference_text(system, user) -> Column:
    """As I1 without the assistant body; ends on the assistant header."""
    return F.concat(
        F.lit(BOS), header("system"), T.py_strip(T.nz(system)), F.lit(EOT),
        header("user"), T.py_strip(T.nz(user)), F.lit(EOT), header("assistant"),
    )


def multi_turn_prompts(
    turns: DataFrame, system, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    keep_last: int = 10,
) -> DataFrame:
    """I3 + I4: per conversation, the last user message is the new message; the
    user/assistant turns before it (the last ``keep_last``) are the history.
    Each task keeps at most ``keep_last`` turns of a conversation before the shuffle."""
    chat = turns.where(F.col(role).isin("user", "assistant"))
    last_user = chat.where(F.col(role) == "user").groupBy(conv).agg(
        F.max_by(F.struct(F.col(turn).alias("t"), F.col(text).alias("x")), F.col(turn)).alias("_lu")
    )
    hist = chat.join(last_user, conv).where(F.col(turn) < F.col("_lu.t")).withColumn("_neg", -F.col(turn))
    hist = first_rows(hist, [conv], ["_neg"], keep_last)
    piece = F.concat(header(F.col(role)), T.py_strip(T.nz(text)), F.lit(EOT))
    hist = hist.groupBy(conv).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), piece.alias("p")))), lambda s: s["p"]), "").alias("_h")
    )
    sys_col = F.lit(system) if isinstance(system, str) else system
    out = last_user.join(hist, conv, "left")
    return out.select(
        conv,
        F.concat(
            F.lit(BOS), header("system"), T.py_strip(sys_col), F.lit(EOT), F.coalesce(F.col("_h"), F.lit("")),
            header("user"), T.py_strip(T.nz(F.col("_lu.x"))), F.lit(EOT), header("assistant"),
        ).alias("prompt"),
    )


def format_check(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row carries the required markers (one summary row)."""
    ok = None
    for m in REQUIRED_MARKERS:
        c = F.contains(F.col(text), F.lit(m))
        ok = c if ok is None else (ok & c)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(~ok, 1)).alias("n_bad"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_ok"),
    )
