"""URL filter: host and path rules, and boosted trees on lexical features for all other URLs.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path goes on up to ``?``, ``#`` or the end. A rule (host/path) fits its
host and all subdomains if the URL's path starts with the rule's; the longest
fitting rule decides (of equally long ones, a block).

URLs that a rule decides are the labelled examples: trees are fitted on at most
``MAX_ROWS`` of them (documented bound: those with the smallest hash of their id)
and judge the rest by length, depth, digit ratio, entropy, parameter counts and
suffix statistics: smoothed shares of blocked examples by the host's last one
and two labels. These are counted over all examples and joined to every URL (a table of
at most ``BROADCAST_SUFFIXES`` suffixes is broadcast); a training row leaves its own label out.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no
rule and is judged by its features; without examples every other URL is allowed
(score 0.5 or less); repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import gbt
from .textblocks import bounded_batches, bounded_sample, table_of, text_buffer

MAX_ROWS = 20_000
BROADCAST_SUFFIXES = 200_000
_SMOOTH = 4  # examples that the overall share counts as
# Verdict and rule, a host and the beginning of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = {"digits": range(0x30, 0x3A), "dots": b".", "hyphens": b"-_", "slashes": b"/", "params": b"&;", "equals": b"=", "percents": b"%", "marks": b"#@~+!$*"}
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "hyphens", "equals", "percents", "marks", "suffix1", "suffix2"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # later ones win
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _sums(v: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(v, dtype=float)])
    return c[offs[1:]] - c[offs[:-1]]


def _entropy(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits a byte of each row's byte distribution."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    cell, c = np.unique(row * 256 + buf, return_counts=True)
    p = c / np.maximum(np.diff(offs), 1)[cell // 256]
    return -np.bincount(cell // 256, weights=p * np.log2(p), minlength=n)


def lexical(url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
    """All features but the suffix statistics."""
    (u, uo), (h, ho), (p, po) = text_buffer(url), text_buffer(host), text_buffer(path)
    of = lambda name, b, o: _sums(table_of(_BYTES[name])[b], o)
    nu, nh = np.maximum(np.diff(uo), 1), np.maximum(np.diff(ho), 1)
    query = _sums(u == 0x3F, uo) > 0
    return np.stack(
        [
            np.diff(uo), np.diff(ho), np.diff(po), of("slashes", p, po), of("dots", h, ho) + (np.diff(ho) > 0), of("digits", u, uo) / nu,
            of("digits", h, ho) / nh, _entropy(u, uo), _entropy(h, ho), of("params", u, uo) + query, of("hyphens", u, uo),
            of("equals", u, uo), of("percents", u, uo), of("marks", u, uo),
        ],
        axis=1,
    ).astype(float)


def _share(blocked: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    return (blocked + _SMOOTH * prior) / (n + _SMOOTH)


class Judge:
    """Trees over lexical features and suffix statistics, the counts of suffixes (by the host's last label and last two), and the overall share."""

    def __init__(self, trees, prior: float, suffixes: tuple[DataFrame, DataFrame]):
        self.trees, self.prior, self.suffixes = trees, prior, suffixes


def with_parts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path and fit (the rule's verdict and rule) added."""
    parts = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


_COUNTS = ("_b1", "_n1", "_b2", "_n2")


def _suffix(k: int) -> Column:
    return F.substring_index("host", ".", -k)


def _with_counts(rows: DataFrame, suffixes: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with the blocked and all examples (0 if none) of their host's suffixes."""
    for k, table in enumerate(suffixes, 1):
        table = table.select(F.col("s").alias(f"_s{k}"), F.col("b").alias(f"_b{k}"), F.col("n").alias(f"_n{k}"))
        table = F.broadcast(table) if table.count() <= BROADCAST_SUFFIXES else table  # else a join whose hot suffixes Spark may split
        rows = rows.withColumn("_s", _suffix(k)).join(table, F.col("_s") == F.col(f"_s{k}"), "left").drop("_s", f"_s{k}")
    return rows.fillna(0, list(_COUNTS))


def train(parts: DataFrame, max_rows: int = MAX_ROWS) -> Judge:
    """Count suffixes over all URLs that a rule decides, and fit trees on at most ``max_rows`` of them."""
    ensure_checkpoint_dir(parts.sparkSession)
    known = parts.where("fit IS NOT NULL").select("page_id", "url", "host", "path", (F.col("fit.verdict") == "block").cast("double").alias("y"))
    counted = [known.groupBy(_suffix(k).alias("s")).agg(F.sum("y").alias("b"), F.count(F.lit(1)).cast("double").alias("n")).checkpoint() for k in (1, 2)]
    blocked, n = counted[0].agg(F.coalesce(F.sum("b"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    prior = (blocked + 0.5) / (n + 1)
    sample = bounded_sample(known, max_rows, "page_id")
    rows = _with_counts(sample, counted).toPandas().sort_values(["page_id", "url"])
    y = rows["y"].to_numpy(float)
    x = lexical(*(pa.array(rows[c].tolist(), pa.string()) for c in ("url", "host", "path")))
    b1, n1, b2, n2 = (rows[c].to_numpy(float) for c in _COUNTS)
    full = np.column_stack([x, _share(b1 - y, n1 - 1, prior), _share(b2 - y, n2 - 1, prior)]) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*full.T, y])
    return Judge(gbt.fit(full[order], y[order]), prior, tuple(counted))


def judge(parts: DataFrame, model: Judge) -> DataFrame:
    """``parts`` (page_id, url, host, path, fit) as page_id, host, path, rule, verdict, score (likeness of a block)."""
    bounded_batches(parts.sparkSession, 10_000)
    shared = parts.sparkSession.sparkContext.broadcast((model.trees, model.prior))  # trees of a bounded sample

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, prior = shared.value
        for batch in batches:
            x = lexical(*(batch.column(c) for c in ("url", "host", "path")))
            b1, n1, b2, n2 = (batch.column(c).to_numpy() for c in _COUNTS)
            p = trees.score(np.column_stack([x, _share(b1, n1, prior), _share(b2, n2, prior)])) if len(x) else np.zeros(0)
            cols = [batch.column(c) for c in ("page_id", "host", "path", "rule", "known")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64())], names=["page_id", "host", "path", "rule", "known", "score"])

    rows = parts.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("known"))
    kind = parts.schema["page_id"].dataType.simpleString()
    out = _with_counts(rows, model.suffixes).mapInArrow(scan, f"page_id {kind}, host string, path string, rule string, known string, score double")
    verdict = F.coalesce("known", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    parts = with_parts(pages.select("page_id", "url"), rules)
    return judge(parts, train(parts))
