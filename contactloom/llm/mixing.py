"""Mixing sources to target weights.

A source's documents stand in an order permuted by a hash and are read over and over, up to `repeats` times: the
source's stream. Targets share the words of all sources by weight and stop at `repeats` times a source's own words;
what is above is shared anew. A stream up to its target is cut into blocks of equal words; the number of blocks is
the source's quota. A splitting tree deals the quotas to output shards: a node's blocks are split in two by a
multivariate-hypergeometric draw, as if the halves were drawn without replacement, until a node is one shard. A
shard takes disjoint blocks of each source, permuted by an affine map, and orders what it has by a hash. Documents stay
whole. A stream stops at the document nearest its target; then one document of the source is taken once more and one
once less, or only one of the two, whichever brings what is taken nearest to the target.

The tree works on one row a node with an array over the sources, so sources are thousands, not millions. Documents meet
only sums by (source, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.llm.common import WORD, Tables, fresh, let, spread, unit

#: A prime above any number of blocks, so that multiplying by it permutes block numbers.
PRIME = (1 << 31) - 1
BLOCKS = 1 << 18


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, repeats: int = 3) -> DataFrame:
    """From rows (source, source_size, weight): with target double. The share per weight is that at the first source,
    by ascending cap per weight, that stays below its cap."""
    by = W.orderBy("__ratio", "__rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    out = sources.withColumn("__cap", F.col("source_size") * float(repeats)).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    out = out.withColumn("__share", (F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(by), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0))))
    out = out.withColumn("__share", F.min_by("__share", F.when(F.col("__ratio") >= F.col("__share"), F.struct("__ratio", "__rank"))).over(every))
    share = F.coalesce(F.col("__share") * F.col("weight"), F.col("__cap"))
    return out.withColumn("target", F.least("__cap", share)).drop("__cap", "__ratio", "__share")


def hypergeometric(good: Column, rest: Column, draws: Column, u: Column) -> Column:
    """A draw by inverse distribution: of `draws` blocks from `good` + `rest`, how many are good. Probabilities are
    taken from the mode outwards by their exact ratios over 12 standard deviations, beyond which doubles hold none."""
    total = good + rest
    low, high = F.greatest(F.lit(0).cast("long"), draws - rest), F.least(good, draws)
    mean = draws * good / F.greatest(total, F.lit(1))
    wide = F.lit(12) * F.sqrt(mean * (F.lit(1) - good / F.greatest(total, F.lit(1))) + 1) + 2
    first, last = F.greatest(low, F.floor(mean - wide)), F.least(high, F.ceil(mean + wide))

    def ratio(x: Column) -> Column:
        return (good - x + 1) * (draws - x + 1) / (x.cast("double") * (rest - draws + x))

    def draw(bounds: Column) -> Column:
        a, span = bounds["a"], F.sequence(bounds["a"], bounds["b"])
        # weights start at 1, some e^-72 of the mode's, and sum to less than a double can hold
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), a.alias("found"))

        def walk(cut: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                w = F.when(x > a, s["w"] * ratio(x)).otherwise(s["w"])
                return let(w, lambda v: F.struct(v.alias("w"), (s["sum"] + v).alias("sum"), (s["found"] + F.when(s["sum"] + v < cut, 1).otherwise(0)).cast("long").alias("found")))

            return F.aggregate(span, start, step)

        return let(walk(F.lit(0.0))["sum"] * u, lambda cut: F.least(walk(cut)["found"], bounds["m"]))

    bounds = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), high.cast("long").alias("m"))
    return F.when(high <= low, low).otherwise(let(bounds, draw)).cast("long")


def split(quotas: Column, draws: Column, seed: Column) -> Column:
    """Quotas (array<bigint>) of the left part of a node: a multivariate-hypergeometric draw, source by source."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    start = F.struct(total.alias("pool"), draws.alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, q: Column) -> Column:
        u = unit(F.xxhash64(seed, F.size(s["out"])))
        return let(hypergeometric(q, s["pool"] - q, s["n"], u), lambda x: F.struct((s["pool"] - q).alias("pool"), (s["n"] - x).alias("n"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(quotas, start, step, lambda s: s["out"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int, tables: Tables | None = None) -> DataFrame:
    """From one row with `quotas` array<bigint>: rows (shard, quotas), whose sums over shards are the quotas given."""
    tables = tables or Tables(quotas.sparkSession, "split")
    nodes, last = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quotas"), []
    while shards > 1:
        shards = (shards + 1) // 2
        size, left = F.col("hi") - F.col("lo"), F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q)
        draws = F.floor(total * left / size).cast("long")
        got = F.when(size > 1, split(F.col("quotas"), draws, F.xxhash64(F.lit(seed), "lo", "hi")))
        nodes = nodes.withColumn("__left", got)
        mid = F.col("lo") + left
        parts = F.when(size <= 1, F.array(F.struct("lo", "hi", "quotas"))).otherwise(
            F.array(
                F.struct("lo", mid.alias("hi"), F.col("__left").alias("quotas")),
                F.struct(mid.alias("lo"), "hi", F.zip_with("quotas", "__left", lambda q, x: q - x).alias("quotas")),
            )
        )
        nodes = tables.written(nodes.select(F.inline(parts)), "split", last)  # one level at a time, else expressions nest
        last = [nodes]
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def mix(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), shards: int = 16, repeats: int = 3, seed: int = 17, chunk_rows: int = 500, content: str = "text") -> DataFrame:
    """The rows with size, source_size, target and `draws`: one struct (shard int, copy int, order long) for each time
    the mix takes the row, none where it is left out. `order` is the shuffled place in a shard.

    Sources are ordered by code point, null (a source like others) last, and take the weights in turn. Rows alike in
    key, source and content are interchangeable; other rows of one key are told apart by content. Rows of size 0 and
    empty tables give no error: their target is 0. Columns of the four names made here are replaced, all others stay,
    whatever their names. All columns that the caller goes on to use move in one shuffle; for wide rows, mix a table of
    keys, sizes and hashes, as the pipeline does."""
    made = ("size", "source_size", "target", "draws")
    keep = [c for c in df.columns if c not in made]
    own = fresh(df, "h", "chunk", "s", "sum", "times", *made)
    h, chunk, s, so_far, times, n, source_size, target, drawn = own
    tables, spark = Tables(df.sparkSession, "mix"), df.sparkSession
    parts = spread(df.count(), chunk_rows, 256)
    df = df.withColumns({n: size, h: F.xxhash64(F.lit(seed), F.col(key), F.col(content)), s: F.col(source)}).select(*keep, n, h, s)
    df = df.withColumn(chunk, F.shiftrightunsigned(h, 65 - parts.bit_length()) if parts > 1 else F.lit(0))
    sums = tables.written(df.groupBy(F.col(s).alias("__source"), F.col(chunk).alias("__chunk")).agg(F.sum(n).alias("__n")), "sums")

    ranked = sums.groupBy("__source").agg(F.sum("__n").alias("source_size"))
    ranked = ranked.withColumn("__rank", F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())))
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = targets(ranked.withColumn("weight", F.get(turn, (F.col("__rank") - 1) % len(weights))), repeats)
    block = F.greatest(F.lit(1.0), F.sum("source_size").over(W.partitionBy()) / F.lit(float(BLOCKS)))
    ranked = ranked.withColumn("__block", block).withColumn("__quota", F.ceil(F.col("target") / F.col("__block")).cast("long"))
    ranked = tables.written(ranked, "sources")

    one = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__quota"))), lambda x: x["__quota"]).alias("quotas"))
    leaves = splitting_tree(one, shards, seed, tables).select("shard", F.posexplode("quotas"))
    ends = F.sum("col").over(W.partitionBy("pos").orderBy("shard"))
    leaves = leaves.withColumn("__end", ends).groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "__end"))), lambda x: x["__end"]).alias("__ends"))
    ranked = ranked.join(leaves, F.col("pos") == F.col("__rank") - 1).drop("pos")
    before = sums.select("__source", "__chunk", (F.sum("__n").over(W.partitionBy("__source").orderBy("__chunk")) - F.col("__n")).alias("__before"))
    # one small table with all that a chunk needs
    plan = before.join(ranked, before["__source"].eqNullSafe(ranked["__source"]))
    plan = plan.select(before["__source"].alias("__s"), F.col("__chunk").alias("__c"), "__before", F.col("source_size").alias("__size"), F.col("target").alias("__target"), "__block", "__quota", "__ends")
    plan = tables.written(plan, "plan", [sums])
    of_plan = dict(zip(plan.columns, fresh(df, *plan.columns), strict=True))
    plan = plan.toDF(*of_plan.values())
    p = {c: F.col(name) for c, name in of_plan.items()}

    inside = W.partitionBy(s, chunk).orderBy(h, F.col(key), n).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumn(so_far, F.sum(n).over(inside))
    out = out.join(plan, F.col(s).eqNullSafe(p["__s"]) & (F.col(chunk) == p["__c"]))
    middle = p["__before"] + F.col(so_far) - F.col(n) / 2

    def draw(copy: Column) -> Column:
        at = copy * p["__size"] + middle
        number = F.pmod(F.floor(at / p["__block"]).cast("long") * PRIME + F.pmod(F.xxhash64(F.lit(seed), F.col(s)), F.lit(PRIME)), F.greatest(p["__quota"], F.lit(1)))
        shard = F.size(F.filter(p["__ends"], lambda e: e <= number))
        return F.struct(shard.alias("shard"), copy.cast("int").alias("copy"), F.xxhash64(F.lit(seed + 1), h, copy).alias("order"))

    # how often the stream up to the target passes the row's middle
    passes = F.when(F.col(n) > 0, F.ceil((p["__target"] - middle) / p["__size"])).otherwise(0)
    out = out.withColumn(times, F.greatest(F.lit(0), F.least(F.lit(repeats), passes)).cast("int"))
    now = out.select(F.col(s).alias("source"), F.col(chunk).alias("chunk"), F.col(so_far).alias("sum"), F.col(n).alias("size"), F.col(times).alias("times"), p["__target"].alias("target"))
    fixes = changes(tables, now, repeats)
    fixes = fixes.toDF(*(f := fresh(out, "f_source", "f_chunk", "f_sum", "f_change")))
    out = out.join(fixes, F.col(s).eqNullSafe(F.col(f[0])) & (F.col(chunk) == F.col(f[1])) & (F.col(so_far) == F.col(f[2])) & (F.col(n) > 0), "left")
    count = F.col(times) + F.coalesce(f[3], F.lit(0))
    draws = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), draw)).otherwise(F.array().cast("array<struct<shard: int, copy: int, order: bigint>>"))
    return out.select(*keep, F.col(n).alias("size"), p["__size"].alias("source_size"), p["__target"].alias("target"), draws.alias("draws"))


def changes(tables: Tables, now: DataFrame, repeats: int, near: float = 1.0, rounds: int = 30) -> DataFrame:
    """(source, chunk, sum, change) from rows (source, chunk, sum, size, times, target): how often more or less documents
    are taken, so that every source comes within `near` words of its target, or as near as documents of one size more and of
    another less bring it."""
    now, done = tables.written(now, "now"), None
    for _ in range(rounds):
        lack = now.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("times"))).alias("lack"))
        lack = tables.written(lack.where(F.abs("lack") > near), "lack")
        found = tables.written(closer(now, lack, repeats), "found", [lack])
        if found.isEmpty():
            break
        done = found if done is None else done.unionByName(found)
        at = found.toDF("f_source", "f_chunk", "f_sum", "change")
        same = F.col("source").eqNullSafe(F.col("f_source")) & (F.col("chunk") == F.col("f_chunk")) & (F.col("sum") == F.col("f_sum")) & (F.col("size") > 0)
        times = (F.col("times") + F.coalesce("change", F.lit(0))).alias("times")
        now = tables.written(now.join(at, same, "left").select("source", "chunk", "sum", "size", times, "target"), "now", [now])
    tables.drop(now)
    done = found if done is None else done
    return done.groupBy("source", "chunk", "sum").agg(F.sum("change").cast("int").alias("change"))


def closer(now: DataFrame, lack: DataFrame, repeats: int) -> DataFrame:
    """(source, chunk, sum, change): of each source in `lack` documents of one size taken once more and as many of another
    once less, or one of the two, so that what is taken comes nearest to the target; none where nothing does. Documents
    meet as distinct sizes of their source: for each size to leave out the nearest sizes to add."""
    lack = lack.withColumnRenamed("source", "s")
    here = now.where("size > 0").join(F.broadcast(lack), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # sources are few
    more, less = F.col("times") < repeats, F.col("times") > 0
    sizes = here.groupBy("source", "size").agg(F.first("lack").alias("lack"), F.count(F.when(more, 1)).alias("more"), F.count(F.when(less, 1)).alias("less"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    none = lack.select(F.col("s").alias("source"), zero.alias("size"), "lack", F.lit(1 << 40).alias("n"))  # to add or leave out nothing
    adds = sizes.where("more > 0").select("source", "size", "lack", F.col("more").alias("n")).unionByName(none).select("source", F.col("size").cast("double").alias("at"), "lack", F.struct("size", "n").alias("more"), F.lit(None).cast("struct<size: bigint, n: bigint>").alias("less"))
    drops = sizes.where("less > 0").select("source", "size", "lack", F.col("less").alias("n")).unionByName(none).select("source", (F.col("size") + F.col("lack")).alias("at"), "lack", F.lit(None).cast("struct<size: bigint, n: bigint>").alias("more"), F.struct("size", "n").alias("less"))
    line = W.partitionBy("source").orderBy("at", F.col("less").isNotNull())
    rows = adds.unionByName(drops).withColumn("below", F.last("more", True).over(line.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("above", F.first("more", True).over(line.rowsBetween(W.currentRow, W.unboundedFollowing)))
    rows = rows.where("less IS NOT NULL").select("source", "less", "at", "lack", F.explode(F.array("below", "above")).alias("more")).where("more IS NOT NULL AND more.size <> less.size")
    step = F.col("more.size") - F.col("less.size")
    # what can be done many times over, where a source lacks many documents
    often = F.greatest(F.lit(1).cast("long"), F.least(F.floor(F.abs("lack") / F.abs(step)), F.col("more.n"), F.col("less.n")))
    best = rows.where(F.abs(F.col("lack") - step) < F.abs("lack")).groupBy("source").agg(F.min(F.struct(F.abs(F.col("lack") - often * step).alias("off"), (F.col("less.size") + F.col("more.size")).alias("moved"), F.col("less.size").alias("less"), F.col("more.size").alias("more"), often.alias("often"))).alias("b"))
    best = best.select(F.col("source").alias("s"), "b.often", F.explode(F.array(F.struct(F.col("b.more").alias("size"), F.lit(1).alias("change")), F.struct(F.col("b.less").alias("size"), F.lit(-1).alias("change")))).alias("c"))
    found = here.join(F.broadcast(best), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("c.size")) & F.when(F.col("c.change") > 0, more).otherwise(less))
    found = found.withColumn("at", F.row_number().over(W.partitionBy("source", "c").orderBy("chunk", "sum"))).where("at <= often")
    return found.select("source", "chunk", "sum", F.col("c.change").alias("change"))
