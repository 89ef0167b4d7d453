"""Document fingerprints: one-permutation MinHash over shingles of five words.

Each shingle is hashed once. The top bits of the hash name a bin, which keeps its smallest hash. An empty bin is
filled by optimal densification: it probes all bins in an order of its own, by a hash of the pair and the same for every
document, and takes the value of the first that isn't empty. The first probes look that order up, the rest compares the
hashes of the full bins, which comes to the same bin. Of each bin the low 8 bits are stored. Two fingerprints agree in a bin by
chance with probability 2^-8, which the likeness takes off: (m - c) / (1 - c), at least 0.
"""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.llm.common import cut_points, fresh, let, part_of, shingle_hashes

BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
LANES = 64 // LOW_BITS
#: Probes that look the order up.
PROBES = 12
CHANCE = 1.0 / (1 << LOW_BITS)


def bin_of(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS).cast("int")


def probe_order(i: int) -> list[int]:
    """The order in which an empty bin at place i probes all places: by Spark's xxhash64 of the two."""
    pair = lambda b: xxhash.xxh64_intdigest(b.to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42))
    return sorted(range(BINS), key=lambda b: (pair(b) ^ 1 << 63, b))  # as signed numbers


def bin_values(hashes: Column) -> Column:
    """BINS values: each bin's smallest hash, empty bins filled; an empty array for no hashes."""
    # signed order puts the upper half of the bins first
    least = let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))

    place = lambda x: F.pmod(bin_of(x) + BINS // 2, F.lit(BINS)).cast("int")  # noqa: E731  of a bin in signed order

    def placed(f: Column) -> Column:
        gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
        return F.flatten(F.concat(F.array(gap(place(F.get(f, F.lit(0))))), F.transform(f, lambda x, i: F.concat(F.array(x), gap(F.coalesce(place(F.get(f, i + 1)), F.lit(BINS)) - place(x) - 1)))))

    orders = [probe_order(i) for i in range(BINS)]
    tables = [F.lit([o[t] for o in orders]) for t in range(PROBES)]

    def filled(f: Column) -> Column:
        def at(b: Column, i: Column) -> Column:
            probes = [F.get(b, F.get(t, i)) for t in tables]
            # the first full bin of the same order, found by its hash
            rest = F.array_min(F.transform(f, lambda x: F.struct(F.xxhash64(i, place(x)).alias("h"), x.alias("x"))))["x"]
            return F.coalesce(F.get(b, i), *probes, rest)

        return F.when(F.size(f) == 0, f).when(F.size(f) == BINS, f).otherwise(let(placed(f), lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: at(b, i))))

    return let(least, filled)


def packed(values: Column) -> Column:
    """The low bits of the bins as longs, LANES of them in each."""

    def word(v: Column, k: Column) -> Column:
        parts = [F.shiftleft(F.get(v, k * LANES + j).bitwiseAND(F.lit((1 << LOW_BITS) - 1)), LOW_BITS * j) for j in range(LANES)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lambda k: word(v, k))))


def fingerprint(text: Column) -> Column:
    """array<bigint>; empty for null and for texts without words. Equal texts have equal fingerprints."""
    return packed(bin_values(shingle_hashes(text)))


def hexed(longs: Column) -> Column:
    return F.array_join(F.transform(longs, lambda p: F.lpad(F.hex(p), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard index of two texts' shingles by their fingerprints; 1 where both are empty, 0 where one is."""

    def fold(shift: int, mask: int) -> Callable[[Column], Column]:
        return lambda v: v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))

    def differing(x: Column) -> Column:
        """Of the LANES bytes of x, how many aren't 0."""
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = let(x, fold(shift, mask))
        return F.bit_count(x)

    wrong = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    same = (F.lit(float(BINS)) - wrong) / F.lit(float(BINS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (same - CHANCE) / (1 - CHANCE)))


def with_next(df: DataFrame, key: str, text: str, derive: dict[str, Callable[[Column], Column]], rows_per_part: int = 500) -> DataFrame:
    """Each row's successor by descending key (null last; rows of one key by text), the last row's being the first:
    `next_<column>` for the text and the columns of `derive`, which are made of the text, once a row. Rows are parted by
    key range, and each part gets a guard, the first row of the part below, so that no task sorts all rows. Other columns
    stay, whatever their names; those of `derive` and next_<column> are replaced."""
    cuts = cut_points(df, key, rows_per_part)
    part, least, to, guard, shown = fresh(df, "part", "least", "to", "guard", "shown")
    df = df.withColumn(part, part_of(F.col(key), cuts)).withColumn(shown, F.coalesce(text, F.lit("")))
    first = df.groupBy(part).agg(F.max(key).alias(least))
    down = W.orderBy(F.col(part).desc())
    first = first.withColumn(to, F.coalesce(F.lag(part).over(down), F.min(part).over(W.partitionBy())))
    bounded = F.broadcast(first) if len(cuts) < (1 << 16) else first  # a row a part
    g = df.join(bounded, part).where(F.col(key).eqNullSafe(F.col(least))).groupBy(to).agg(F.min(shown).alias(shown))
    last = g.select(F.col(to).alias(part), F.lit(True).alias(guard), F.col(shown), F.col(shown).alias(text))
    both = df.withColumn(guard, F.lit(False)).unionByName(last, allowMissingColumns=True)
    both = both.withColumns({c: f(F.col(text)) for c, f in derive.items()})
    order = W.partitionBy(part).orderBy(guard, F.col(key).desc(), shown)
    for c in (text, *derive):
        both = both.withColumn(f"next_{c}", F.lead(c).over(order))
    return both.where(~F.col(guard)).drop(guard, part, shown)


def edited(text: Column, following: Column) -> Column:
    """The text with its last half of code points replaced by as many of the next document's first."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
