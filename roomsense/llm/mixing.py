"""Mixing sources to target weights by entropy balancing.

Every source gets a target of tokens: its weight's share of ``total_share`` times all tokens, at most ``most_copies``
times its own tokens, the excess reshared by weight.  Documents get rates r(d) in [0, most_copies] of least relative
entropy that meet the target exactly in expectation.  By convex duality the rates are exponentially tilted by one
multiplier per source, r = c * t / (1 + t) with t = exp(lambda * size / mean size) and c = most_copies, and the multiplier
minimises sum(c * log(1 + t)) - lambda * target, which safeguarded Newton steps solve.  Rates depend on source and size
only, so the steps run on the table of (source, size, count), aggregated once before any shuffle of documents.

Rates become whole copies by error diffusion over those cells, from the largest size down: a cell takes the whole number
of copies nearest to its expected tokens plus what the cells before it missed, so a source's taken tokens differ from its
target by about half the smallest size used.  The cells of one source are its distinct sizes, a summary that does not grow
with copies of documents.  A cell's copies are dealt evenly along the hash of the id, so reruns agree; a cell of many
documents is split into parts of about ``cell_rows`` rows, each ranked by itself after an offset known from the counts.

A null text has size 0; documents of size 0 and sources without tokens take 0; a null source is a source of its own, the
last; repeated rows are ranked one after the other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomsense.llm.common import SPACES, pick, written


def word_count(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.size(F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), total_share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """(source, source_size) -> source, source_size, target.  One row per source; sources by code point, null last.

    With all targets min(cap, level * weight), the level is found from the sources in order of cap / weight.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    cap = F.lit(float(most_copies)) * F.col("source_size")
    s = sources.withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("total", F.sum("source_size").over(everything) * total_share)
         .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))))
    level = (F.col("total") - F.col("full")) / F.col("open")   # if this source and all after it were open
    held = F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_ratio).alias("at"), level.alias("level")))
    s = s.withColumn("held", held)
    s = s.withColumn("level", F.min("held").over(everything)["level"])   # of the first source that its cap does not stop
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def solve(cells: DataFrame, wanted: DataFrame, most_copies: int = 2, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """Newton iterations for the multipliers: (source, size, n) and (source, source_size, target) -> source, lambda, mean.

    Each step is one aggregation per source over the cells.  A step that leaves the bracket of the root is replaced by
    the bracket's middle.  A target of all copies (or of none) has its multiplier at infinity.
    """
    c = float(most_copies)
    n = cells.groupBy("source").agg(F.sum("n").alias("docs"))
    state = (wanted.join(n, wanted["source"].eqNullSafe(n["source"])).drop(n["source"])
             .withColumn("mean", F.col("source_size") / F.col("docs"))
             .withColumn("goal", F.col("target") / F.col("mean"))     # in units of the mean size
             .select("source", "source_size", "target", "mean", "goal", F.lit(0.0).alias("lambda"), F.lit(-1024.0).alias("low"), F.lit(1024.0).alias("high"),
                     (F.col("target") >= c * F.col("source_size")).alias("full")))
    share = F.least(F.greatest(F.col("target") / (c * F.col("source_size")), F.lit(1e-6)), F.lit(1 - 1e-6))
    state = written(state.withColumn("lambda", F.log(share / (1 - share))).drop("source_size"), "multipliers")
    for _ in range(most_steps):
        s = state.alias("s")
        z = F.col("s.lambda") * F.col("size") / F.col("s.mean")
        p = 1 / (1 + F.exp(-z))
        x = F.col("size") / F.col("s.mean")
        sums = (cells.alias("k").join(s, F.col("k.source").eqNullSafe(F.col("s.source"))).where("not s.full and s.mean > 0")
                .groupBy(F.col("s.source").alias("of"))
                .agg(F.sum(F.col("n") * c * p * x).alias("got"), F.sum(F.col("n") * c * p * (1 - p) * x * x).alias("slope")))
        state = (s.join(sums, F.col("s.source").eqNullSafe(F.col("of")), "left")
                 .withColumn("error", F.coalesce((F.col("got") - F.col("goal")) / F.greatest("goal", F.lit(1e-300)), F.lit(0.0)))
                 .withColumn("new_low", F.when(F.col("error") < 0, F.col("s.lambda")).otherwise(F.col("low")))
                 .withColumn("new_high", F.when(F.col("error") > 0, F.col("s.lambda")).otherwise(F.col("high")))
                 .withColumn("step", F.col("s.lambda") - F.try_divide(F.col("got") - F.col("goal"), "slope"))
                 .withColumn("next", F.when(F.abs("error") <= tolerance, F.col("s.lambda"))
                             .when((F.col("step") > F.col("new_low")) & (F.col("step") < F.col("new_high")), F.col("step"))
                             .otherwise((F.col("new_low") + F.col("new_high")) / 2)))
        state = written(state.select("s.source", "target", "mean", "goal", F.col("next").alias("lambda"), F.col("new_low").alias("low"),
                                     F.col("new_high").alias("high"), "full", "error"), "multipliers")
        if (state.agg(F.max(F.abs("error"))).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("error")
    return state.select("source", "target", "mean", "lambda", "full")


def _diffuse(most_copies: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, kind="stable")
        missed, taken = 0.0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            if not size:
                taken.append(0)
                continue
            due = n * rate * size + missed
            copies = min(most_copies * n, max(0, math.floor(due / size + 0.5)))
            taken.append(copies)
            missed = due - copies * size
        return cells.assign(cell_copies=taken)
    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1),
        total_share: float = 1.5, most_copies: int = 2, cell_rows: int = 256, row_col: str | None = None) -> DataFrame:
    """Every row with size, source_size, target, rate and copies: ``id_col``, ``source_col`` and these.

    Only slim rows (id, source, size) are written and shuffled, never texts.  ``row_col``, a key of the rows where ids are
    null or repeated, is returned too and settles the order of equal ids.
    """
    key = {"row": row_col} if row_col else {}
    rows = pick(docs, id=id_col, source=source_col, text=text_col, **key)
    rows = written(rows.select("id", "source", *key, word_count(F.col("text")).alias("size")), "sizes")
    cells = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "size-cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = written(targets(sizes, weights, total_share, most_copies), "targets")
    state = solve(cells.where("size > 0"), wanted, most_copies).drop("target")

    z = F.col("lambda") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), float(most_copies)).otherwise(float(most_copies) / (1 + F.exp(-z)))
    # sums in another order differ in the last bits; rounded, reruns agree
    rated = (cells.alias("k").join(wanted.alias("w"), F.col("k.source").eqNullSafe(F.col("w.source")))
             .join(state.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")), "left")
             .select("k.source", "size", "n", "source_size", "target", F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("rate")))
    rated = written(rated.groupBy("source").applyInPandas(_diffuse(most_copies), rated.schema.simpleString()[7:-1] + ", cell_copies long")
                    .withColumn("parts", F.ceil(F.col("n") / F.lit(cell_rows))), "rates")

    order = F.xxhash64("id")
    placed = (rows.alias("d").join(rated.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.size") == F.col("k.size")))
              .select("d.id", *(f"d.{c}" for c in key), "d.source", "d.size", "source_size", "target", "rate", "n", "cell_copies", "parts", order.alias("order"))
              .withColumn("part", F.pmod(F.xxhash64("order", F.lit(1)), F.col("parts"))))
    few, many = F.col("parts") == 1, F.col("parts") > 1
    part_n = placed.where(many).groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    in_cell = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_n = part_n.withColumn("skip", F.coalesce(F.sum("m").over(in_cell), F.lit(0))).drop("m").alias("p")
    split = (placed.where(many).alias("d").join(part_n, F.col("d.source").eqNullSafe(F.col("p.source"))
                                                & (F.col("d.size") == F.col("p.size")) & (F.col("d.part") == F.col("p.part")))
             .select("d.*", "skip"))
    ranked = placed.where(few).withColumn("skip", F.lit(0).cast("long")).unionByName(split)
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("order", "id", *key)) + F.col("skip")
    dealt = ranked.withColumn("rank", rank.cast("long"))
    out = dealt.withColumn("copies", F.expr("rank * cell_copies div n - (rank - 1) * cell_copies div n"))
    return out.select(F.col("id").alias(id_col), *(F.col(c).alias(name) for c, name in key.items()), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies")
