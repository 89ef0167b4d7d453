"""Domains by a chain of four states whose emissions are mixtures: start, downstream, upstream, end.

A domain starts with one place of strong downstream bias, goes on with some of downstream, then of upstream bias, and ends
with one of strong upstream bias. Moves that the chain lacks stay at 0 however it is trained. A round of training sums the
expected counts of each run of the index in a task and adds them up; only these sums reach the driver. What is trained is
a table of 4 x 3 mixture parts and 7 moves, which can be written and applied to any index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions import kernels
from contactloom.operators import sequences
from contactloom.operators.written import written

#: Parts of a state's mixture, how far apart their means start, the shift of the outer states, and the moves of the chain
#: to begin with (fixed values).
PARTS, SPREAD, SHIFT = 3, 7.5, 2.5
MOVES = {(0, 1): 1.0, (1, 1): 0.5, (1, 2): 0.5, (2, 2): 0.5, (2, 3): 0.5, (3, 0): 0.5, (3, 4): 0.5}
#: The state after the last place.
END = 4
MODEL = "kind string, a int, b int, weight double, mean double, variance double"
Chain = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def initial() -> Chain:
    """(moves, weights, means, variances) before training: rows of moves have the end as their fifth column."""
    moves = np.zeros((4, 5))
    for (a, b), p in MOVES.items():
        moves[a, b] = p
    step = SPREAD / (PARTS - 1)
    up = np.arange(PARTS) * step
    means = np.stack([-up - SHIFT, -up, up, up + SHIFT])
    return moves, np.full((4, PARTS), 1 / PARTS), means, np.full((4, PARTS), step**2)


def table_of(spark: SparkSession, chain: Chain) -> DataFrame:
    moves, weights, means, variances = chain
    rows = [("part", a, b, float(weights[a, b]), float(means[a, b]), float(variances[a, b])) for a in range(4) for b in range(PARTS)]
    rows += [("move", a, b, float(moves[a, b]), None, None) for a, b in MOVES]
    return spark.createDataFrame(rows, MODEL)


def chain_of(model: DataFrame) -> Chain:
    """The chain of a model's 19 rows."""
    moves, (weights, means, variances) = np.zeros((4, 5)), np.zeros((3, 4, PARTS))
    for r in model.collect():
        if r["kind"] == "move":
            moves[r["a"], r["b"]] = r["weight"]
        else:
            weights[r["a"], r["b"]], means[r["a"], r["b"]], variances[r["a"], r["b"]] = r["weight"], r["mean"], r["variance"]
    return moves, weights, means, variances


def filled_runs(index: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, run, idx, di): the index in runs without zeros; `run` is the place where one starts."""
    rows = index.select(F.struct(*keys).alias("chrom"), F.col("idx").cast("long").alias("idx"), (F.coalesce("di", F.lit(0.0)) != 0).alias("value"), "di")
    spans = sequences.runs(rows.drop("di")).where("value").select("chrom", F.col("start").alias("run"), "end")
    at = spans.select("chrom", "run", F.explode(F.sequence(F.col("run"), F.col("end") - 1)).alias("idx"))
    return rows.drop("value").join(at, ["chrom", "idx"]).select("chrom.*", "run", "idx", "di")


def expecting(chain: Chain, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def expect(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([kernels.chain_sums(part.sort_values("idx")["di"].to_numpy(float), *chain)], columns=names)

    return expect


def trained(index: DataFrame, keys: tuple[str, ...] = ("chrom",), least: int = 20, rounds: int = 200, gain: float = 1e-5) -> DataFrame:
    """The model (kind, a, b, weight, mean, variance) trained on runs of more than `least` places without zeros, until a
    round raises the log-likelihood by less than `gain` a place; the initial one where there is no such run."""
    spark = index.sparkSession
    rows = filled_runs(index, keys)
    long = rows.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    rows = written(rows.join(long.drop("n"), [*keys, "run"]).withColumn("di", F.col("di").cast("double")), "runs")
    chain, last = initial(), -np.inf
    places = rows.count()
    if not places:
        return table_of(spark, chain)
    size = 1 + 20 + 3 * 4 * PARTS
    names = [f"s{k}" for k in range(size)]
    for _ in range(rounds):
        sums = rows.groupBy(*keys, "run").applyInPandas(expecting(chain, names), ", ".join(f"{n} double" for n in names))
        got = np.array(sums.agg(*[F.sum(n).alias(n) for n in names]).first())
        now, counts, held = got[0], got[1:21].reshape(4, 5), got[21:].reshape(3, 4, PARTS)
        moves, weights, means, variances = chain
        if not held[0].any():
            break
        moves = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
        weights = held[0] / np.maximum(held[0].sum(axis=1, keepdims=True), 1e-300)
        seen = held[0] > 1e-9
        means = np.where(seen, held[1] / np.maximum(held[0], 1e-9), means)
        variances = np.where(seen, np.maximum(held[2] / np.maximum(held[0], 1e-9) - means**2, 1e-3), variances)
        chain = moves, weights, means, variances
        if now - last < gain * places:
            break
        last = now
    return table_of(spark, chain)


def states(index: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(*keys, run, idx, state): the likeliest states of each run without zeros; runs too short for the chain have none."""
    chain, rows = chain_of(model), filled_runs(index, keys)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def decode(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        found = kernels.likeliest_chain(part["di"].to_numpy(float), *chain)
        part = part.assign(state=found) if len(found) else part.iloc[:0].assign(state=np.zeros(0, int))
        return part[[*keys, "run", "idx", "state"]]

    return rows.groupBy(*keys, "run").applyInPandas(decode, f"{kinds}, run bigint, idx bigint, state int")


def called(index: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(*keys, start, end): domains, each from a place of the first state to the end of the next place of the last."""
    from pyspark.sql import Window as W

    edges = states(index, model, keys).where("state IN (0, 3)")
    follows = F.lead(F.struct("idx", "state")).over(W.partitionBy(*keys, "run").orderBy("idx"))
    edges = edges.withColumn("next", follows).where("state = 0 AND next.state = 3")
    return edges.select(*keys, F.col("idx").alias("start"), (F.col("next.idx") + 1).alias("end"))
