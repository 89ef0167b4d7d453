"""Queries whose operators have a numeric kernel; SQL can't give their rows, tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import assembly, axis, calling, contacts, domains, intervals, models, sequences, smooths
from contactloom.operators.written import written
from contactloom.plans import commands
from contactloom.plans.relational import _numbered_svs
from contactloom.sources import views


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return models.isotonic_curve(contacts.expected(views.pixels(spark, d), views.bins(spark)), views.PER_CHROM - 1)


def _frame(spark: SparkSession) -> DataFrame:
    return axis.axis(views.blocks(spark), views.bins(spark), views.BIN_SIZE)


def _moved(spark: SparkSession, d: str) -> DataFrame:
    return axis.remapped(views.pixels(spark, d), _frame(spark))


def _by_block(spark: SparkSession, d: str) -> DataFrame:
    place = _frame(spark).select("idx", "block")
    rows = _moved(spark, d).join(place.select(F.col("idx").alias("i"), F.col("block").alias("block1")), "i").join(place.select(F.col("idx").alias("j"), F.col("block").alias("block2")), "j")
    return rows.withColumnRenamed("count", "value")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return sequences.log2_levels(views.track(spark, d)).select("chrom", "idx", F.col("log2").alias("x"))


def distance_expected_isotonic(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d)


def _decay(spark: SparkSession, d: str) -> DataFrame:
    return axis.decay(_moved(spark, d), _frame(spark), views.bins(spark), 60)


def huber_decay_slope(spark: SparkSession, d: str) -> DataFrame:
    return models.best_slopes(_decay(spark, d), _curve(spark, d), ["block1", "block2"], [10, 20, 40, 60])


def rescaled_contacts(spark: SparkSession, d: str) -> DataFrame:
    return models.rescaled(_moved(spark, d), _frame(spark), huber_decay_slope(spark, d))


def classwise_balance(spark: SparkSession, d: str) -> DataFrame:
    return models.balanced_by_class(views.pixels(spark, d), views.bins(spark), rounds=1000)


def poisson_profile(spark: SparkSession, d: str) -> DataFrame:
    bins = views.bins(spark)
    rows = bins.join(contacts.marginals(views.pixels(spark, d)), "bin_id", "left").join(intervals.counted_in_bins(views.sites(spark, d), bins, views.BIN_SIZE), "bin_id")
    return models.poisson_profile(rows.select("bin_id", F.coalesce("coverage", F.lit(0)).alias("coverage"), F.col("n").alias("sites"), (F.col("bin_id") % 100 + 1).alias("place")), ["sites", "place"])


def poisson_smooths(spark: SparkSession, d: str) -> DataFrame:
    """Coverage over what smooth functions of two covariates let expect."""
    bins = views.bins(spark)
    rows = bins.join(contacts.marginals(views.pixels(spark, d)), "bin_id", "left").join(intervals.counted_in_bins(views.sites(spark, d), bins, views.BIN_SIZE), "bin_id")
    return smooths.profile(rows.select("bin_id", F.coalesce("coverage", F.lit(0)).alias("coverage"), F.col("n").alias("sites"), (F.col("bin_id") % 100 + 1).alias("place")), ["sites", "place"])


def gmm_states(spark: SparkSession, d: str) -> DataFrame:
    return models.mixture_states(_levels(spark, d), "x")


def hmm_segments(spark: SparkSession, d: str) -> DataFrame:
    return sequences.runs(models.hidden_states(_levels(spark, d)).withColumnRenamed("state", "value"))


def cbs_segments(spark: SparkSession, d: str) -> DataFrame:
    return models.change_points(_levels(spark, d))


def window_features(spark: SparkSession, d: str) -> DataFrame:
    pixels = views.pixels(spark, d)
    return calling.windows(contacts.candidates(pixels, views.bins(spark), 6, 40), pixels, _curve(spark, d))


def scored_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A scorer by expression: the centre's share of centre and corner."""
    return models.scored(window_features(spark, d), F.col("center") / (F.col("center") + F.col("corner")), 0.6).select("bin1_id", "bin2_id", "prob")


def cluster_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_block(spark, d).where("value >= 2")
    return models.clustered(rows, ["block1", "block2"], 2.0)


def loop_anchors(spark: SparkSession, d: str) -> DataFrame:
    return calling.anchors(_by_block(spark, d).where("value >= 2"), ["block1", "block2"], 10_000)


def block_stretches(spark: SparkSession, d: str) -> DataFrame:
    return models.block_bounds(_by_block(spark, d), ["block1", "block2"])


def simulated_contacts(spark: SparkSession, d: str) -> DataFrame:
    return models.simulated(views.pixels(spark, d), views.bins(spark), 2)


def neo_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains on the axes of all assemblies, by a chain trained on the chromosomes."""
    pixels, bins = views.pixels(spark, d), views.bins(spark)
    cis = contacts.paired(pixels, bins, "chrom").where("chrom1 = chrom2").select(F.col("chrom1").alias("chrom"), F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), F.col("count").alias("value"))
    model = domains.trained(models.directionality(cis, 20, ("chrom",)))
    blocks, members = axis.classes(views.assembly_blocks(spark, d), "assembly")
    frame = axis.axis(blocks, bins, views.BIN_SIZE, ("assembly",))
    moved = axis.remapped(pixels, frame, ("assembly",)).withColumnRenamed("count", "value")
    index = written(models.directionality(moved, 10, ("assembly",), frame), "index")
    return axis.for_members(domains.called(index, model, ("assembly",)), members, "assembly")


def structure_coords(spark: SparkSession, d: str) -> DataFrame:
    """Places in space of the bins of every assembly."""
    blocks, members = axis.classes(views.assembly_blocks(spark, d), "assembly")
    moved = axis.remapped(views.pixels(spark, d), axis.axis(blocks, views.bins(spark), views.BIN_SIZE, ("assembly",)), ("assembly",))
    placed = written(models.structures(moved.select("assembly", "i", "j", F.col("count").alias("value")), ["assembly"]), "placed")
    return axis.for_members(placed, members, "assembly")


def keyed_loops(spark: SparkSession, d: str) -> DataFrame:
    """Loops on the axes of all assemblies, in one job."""
    score = F.col("center") / (F.col("center") + F.col("corner"))
    return commands.call_loops(views.pixels(spark, d), views.bins(spark), views.assembly_blocks(spark, d), views.BIN_SIZE, score, 0.7, upper=30, half=2, ranges=(15_000, 30_000))


def bounded_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of all rearrangements within the bounds of what they induce."""
    svs = _numbered_svs(spark, d).withColumns({c: F.concat(F.lit("chr"), c) for c in ("c1", "c2")})
    return assembly.allele_slopes(views.pixels(spark, d), views.bins(spark), svs, _curve(spark, d), 15_000, views.BIN_SIZE, ranges=(8_000, 15_000), bounded=True)


def anchored_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each pair of blocks by the rectangles of their anchors."""
    rows = _by_block(spark, d).where("value >= 2")
    return calling.clustered_by_anchors(rows, ["block1", "block2"], 10_000)


def absorbed_segments(spark: SparkSession, d: str) -> DataFrame:
    coarse = views.track(spark, d).select("chrom", "idx", F.floor(F.col("value") / 4).alias("value"))
    return sequences.absorb_and_merge(sequences.runs(coarse).withColumnRenamed("value", "cn"), 5)


QUERIES = {
    f.__name__: f
    for f in (
        distance_expected_isotonic, huber_decay_slope, rescaled_contacts, classwise_balance, poisson_profile, poisson_smooths, gmm_states, hmm_segments, cbs_segments, window_features, scored_candidates,
        cluster_candidates, loop_anchors, block_stretches, simulated_contacts, neo_domains, structure_coords, absorbed_segments, keyed_loops, bounded_slopes, anchored_calls,
    )
}
