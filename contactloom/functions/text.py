"""Expressions on chromosome names, regions and BED lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_chrom(c: Column) -> Column:
    """Without leading letters c, h and r, in any order and number."""
    return F.ltrim(c, F.lit("chr"))


def prefix(names: Column) -> Column:
    """The prefix of a set of names, as an aggregate: `chr` where the first by code point starts with it, else none."""
    return F.when(F.startswith(F.min(names), F.lit("chr")), "chr").otherwise("")


def toggled_chrom(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("chr")), F.substring(c, F.lit(4), F.length(c))).otherwise(F.concat(F.lit("chr"), c))


def chrom_order(c: Column) -> Column:
    """A struct that sorts names by number, then X, Y, M, then the rest by name."""
    number = F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("int")
    last = bare_chrom(c)
    return F.struct(F.when(number.isNotNull(), 0).when(last == "X", 1).when(last == "Y", 2).when(last == "M", 3).otherwise(4).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), c.alias("name"))


def region(text: Column) -> Column:
    """struct<chrom, start, end> of `chrom:start-end`, characters ,.;|!{}() left out; null where it isn't one or the end
    is before the start. `chrom` and `chrom:start` are open."""
    clean = F.regexp_replace(text, r"[,.;|!{}()]", "")
    found = lambda i: F.nullif(F.regexp_extract(clean, r"^([^:\s]+)(?::(\d+)(?:-(\d+))?)?$", i), F.lit(""))
    start, end = F.coalesce(found(2).cast("long"), F.lit(0).cast("long")), found(3).cast("long")
    return F.when(found(1).isNotNull() & (end.isNull() | (end >= start)), F.struct(found(1).alias("chrom"), start.alias("start"), end.alias("end")))


def region_text(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def human_position(p: Column) -> Column:
    """1500000 as 1M500K, below a thousand as it is."""
    m, k, b = F.floor(p / 1_000_000), F.floor(p % 1_000_000 / 1000), p % 1000
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    return F.when(p == 0, "0").otherwise(F.concat(part(m, "M"), part(k, "K"), F.when(b > 0, b.cast("string")).otherwise("")))


def bed_type(line: Column) -> Column:
    """bed3, bed4, bed6, bed9 or bed12 by the number of fields, bedgraph for four with a numeric last; null for comments,
    headers and blank lines."""
    fields = F.split(F.trim(line), r"\s+")
    n = F.size(fields)
    skip = (F.trim(line) == "") | F.startswith(line, F.lit("#")) | F.startswith(line, F.lit("track")) | F.startswith(line, F.lit("browser"))
    numeric = F.get(fields, F.lit(3)).try_cast("double").isNotNull()
    return F.when(~skip, F.when(n >= 12, "bed12").when(n >= 9, "bed9").when(n >= 6, "bed6").when(n == 4, F.when(numeric, "bedgraph").otherwise("bed4")).when(n >= 3, "bed3"))
