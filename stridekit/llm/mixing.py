"""Mixing sources to target sizes by subset-sum budget fitting.

Sources get shares of a budget by weight; a target stops at ``most`` times its source's
size, and what is over is shared again by weight until no target is above. That is one
level for all that are not stopped, found from running sums over the sources in the order
in which they stop.

A source gives every document as many whole times as its target allows, and the budget
that remains is fitted from a histogram: documents are counted by their exact length
(source, length, count), so a source's fit reads at most one row a length and never its
documents. A budget beyond ``WINDOW`` is first spread over all lengths in proportion; what is
left is a bounded knapsack over the remaining counts, solved by dynamic programming over
all sums up to twice that rest, and the sum nearest to it is taken. The result says how
many documents of each length are taken once more; which, the smallest seeded hashes say,
by exact ranks that split a hot (source, length) over tasks.

Edge cases: a null source is a source of its own, the last by order; an empty one is
another. A null size counts 0, a negative one too; documents of size 0 take 0 and a source of size 0 has
target 0. Repeated rows are documents of their own, ties between them hold equal
columns of the digest. An empty table gives no rows. Existing columns named like an added one are
replaced; others are kept.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import row_numbers, running_aggregates
from ..session import ensure_checkpoint_dir
from .textblocks import without

#: Budget (in the unit of the sizes) that the dynamic programme fits; more is spread in proportion first.
WINDOW = 1 << 18
SEED = 42
ADDED = ("source_size", "target", "copies", "taken")


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_budget(length: np.ndarray, count: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many items of each (distinct, positive) length to take, for a total as near ``budget`` as can be.

    Up to ``window`` the answer is the best of all choices (the smaller total in a tie); beyond it, the
    best among those that hold the proportional part.
    """
    take = np.zeros(len(length), np.int64)
    order = np.argsort(-length, kind="stable")
    rest = int(budget)
    if rest > window:
        spread, total = rest - window // 2, int(length @ count)
        so_far = given = 0
        for i in order:  # longest first; what a length leaves over goes on to shorter ones
            l, c = int(length[i]), int(count[i])
            so_far += l * c
            take[i] = n = min(c, (spread * so_far // total - given) // l)
            given += n * l
        rest -= given
    top = 2 * rest  # a sum beyond it is no nearer than taking nothing
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    by = np.full(top + 1, -1, np.int32)  # the item that reached a sum first
    items: list[tuple[int, int]] = []
    for i in order:
        l, c = int(length[i]), min(int(count[i] - take[i]), top // int(length[i]))
        part = 1
        while c > 0 and not reached[rest]:  # 1, 2, 4, ... and the remainder make every number up to c
            n = min(part, c)
            new = np.flatnonzero(reached[: top + 1 - n * l] & ~reached[n * l :]) + n * l
            by[new], reached[new] = len(items), True
            items.append((int(i), n))
            c -= n
            part *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(length[i])
    return take


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, source_size, target of a table (source, source_size), weights dealt by code point, null last."""
    rows = sources.select("source", "source_size", F.col("source").isNull().cast("int").alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    placed = row_numbers(rows, [], ["none", "name"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = placed.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most).withColumn("stop", F.col("cap") / F.col("weight"))
    summed = running_aggregates(capped, [], ["stop", "none", "name"], {"caps": ("cap", "sum"), "shares": ("weight", "sum")}).checkpoint()
    whole = summed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # the level if every source that stops earlier is stopped; the first source that it does not stop has the level of all others
    here = (F.col("all_size") * share - (F.col("caps") - F.col("cap"))) / (F.col("all_weight") - (F.col("shares") - F.col("weight")))
    levels = summed.crossJoin(F.broadcast(whole)).withColumn("level", here).where(F.col("weight") * F.col("level") <= F.col("cap"))
    level = levels.agg(F.min_by("level", F.struct("stop", "none", "name")).alias("level"))  # one row, as is ``whole``
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return summed.crossJoin(F.broadcast(level)).select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


_PLAN = "source string, size long, base long, more long, source_size long, target double"


def _planned(window: int):
    def fit(t: pa.Table) -> pa.Table:
        sizes, counts = t.column("size").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.int64)
        whole, target = int(t.column("source_size")[0].as_py()), float(t.column("target")[0].as_py())
        base = int(target // whole) if whole else 0
        some = sizes > 0
        more = np.zeros(len(sizes), np.int64)
        if whole:
            more[some] = fit_budget(sizes[some], counts[some], int(np.floor(target - base * whole + 0.5)), window)
        return pa.table(
            {"source": t.column("source"), "size": t.column("size"), "base": np.full(len(sizes), base), "more": more, "source_size": t.column("source_size"), "target": t.column("target")}
        )

    return fit


def mix(
    df: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = SEED,
    window: int = WINDOW,
) -> DataFrame:
    """``df`` with source_size, target (of the row's source), copies (0 to ``most``) and taken (copies x size).

    ``size`` is a whole number; ``share`` times the sum of all sizes is shared. Only the columns
    of ``df`` travel: pass what is needed later (texts can be joined by a unique key).
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = without(df, *ADDED)
    held = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(F.struct(*kept.columns).alias("row"), F.col(source).cast("string").alias("source"), held.cast("long").alias("size"),
                     F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(key).alias("key")).checkpoint()
    histogram = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sources, weights, share, most).withColumnRenamed("source", "of")
    known = histogram.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = known.groupBy("source").applyInArrow(_planned(window), _PLAN).withColumnsRenamed({"source": "of", "size": "len"})
    ranked = row_numbers(rows, ["source", "size"], ["h", "key"], "rank")
    planned = ranked.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("len")))
    copies = (F.col("base") + (F.col("rank") <= F.col("more")).cast("long")).alias("copies")
    taken = ((F.col("base") + (F.col("rank") <= F.col("more")).cast("long")) * F.col("size")).alias("taken")
    return planned.select("row.*", "source_size", "target", copies, taken)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mix`` as often as ``copies`` says, without the added columns."""
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(*ADDED)


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size (words), source_size, target, taken for every document."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(sized, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")
