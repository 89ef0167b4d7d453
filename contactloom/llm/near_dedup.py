"""Near-duplicates by bottom-k sketches.

One hash function orders the shingles of a text; its sketch is the K least. Texts of equal sets are one class, by a hash
of the set that a second hash confirms.
Sketch values are counted over the corpus; a class keeps the rarest ones that it needs, so that two classes whose
sketches share as many values as a link asks for meet in at least one inverted list (prefix filter). A link of J >= t
shares each of the K least values of the union with probability t; `shared_at_least` leaves out one link in 10^10.

1. Lists of short sketches find the classes that may have a partner at all. Only their texts are fetched again.
2. Lists of long sketches, which are whole sets for most texts, give pairs. A class's place in a list, by rarity, bounds
   what the pair can share, and a pair that can't reach the level ends in the join.
3. The sketch of the union estimates the overlap, and full sets confirm it.

Only components are asked for, so pairs inside a known component are not made. First, in each list, one member
meets all others: a spanning set, linear in the lists. Each class tries its best partner, then
the others outside its component. What is left are pairs of one list in different components: classes of
such lists meet in lists of whole sets, where members outside a list's commonest component meet all members of other
components. No pair across components is left out.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.llm.common import Tables, fresh, let, met, shingle_hashes, small
from contactloom.llm.components import components

K, LONG_K = 48, 192
#: As a sketch's length: the whole set.
WHOLE = 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_at_least(k: int, percent: int, missed: float = 1e-10) -> int:
    """The most values that sketches of k share in all but a share `missed` of links at the level."""
    t, below = percent / 100, 0.0
    for m in range(k + 1):
        below += comb(k, m) * t**m * (1 - t) ** (k - m)
        if below > missed:
            return max(1, m)
    return k


def shingle_set(text: Column) -> Column:
    """The distinct hashes of five-word shingles, ascending; A-Z as a-z."""
    return F.sort_array(F.array_distinct(shingle_hashes(F.translate(text, UPPER, LOWER))))


def summary(text: Column) -> Column:
    return let(shingle_set(text), lambda s: F.struct(F.size(s).cast("long").alias("n"), F.xxhash64(s).alias("node"), F.xxhash64(F.lit(1), s).alias("other"), F.slice(s, 1, K).alias("sketch")))


def needed(n: Column, k: int, percent: int) -> Column:
    """How many values of its sketch a class of n shingles shares with one that it links to. Where no partner can have
    more than k shingles, both sketches are whole sets, and the number is exact."""
    exact = F.ceil(n * percent / 100)
    return (exact if k == WHOLE else F.when(n <= k * percent // 100, exact).otherwise(shared_at_least(k, percent))).cast("int")


def can_link(i: Column, k_i: Column, n_i: Column, j: Column, k_j: Column, n_j: Column, k: int, percent: int) -> Column:
    """Whether classes that first meet at places i and j of their sketches can share enough."""
    exact = F.ceil((n_i + n_j) * percent / (100 + percent))
    least = exact if k == WHOLE else F.when((n_i <= k) & (n_j <= k), exact).otherwise(shared_at_least(k, percent))
    return (F.least(k_i - i, k_j - j) >= least) & (100 * F.least(n_i, n_j) >= percent * F.greatest(n_i, n_j))


def inverted_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, node, n, k, at): for each class its rarest sketch values, lists of one left out; at: how many of its sketch
    are rarer."""
    rows = classes.select("node", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    common = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = rows.join(common, "value")
    own = W.partitionBy("node")  # k rows at most
    at = F.col("k") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "value")) - 1
    rows = rows.withColumn("at", at)
    return rows.where(F.col("at") <= F.col("k") - needed(F.col("n"), k, percent)).select("value", "node", "n", "k", "at")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with est, the share of the union's sketch that both have; those that can't reach the level go."""
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    rows = pairs.join(a, "a").join(b, "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, K)
    both = F.array_intersect("s_a", "s_b")
    got = let(union, lambda u: F.struct(F.size(F.array_intersect(u, both)).alias("x"), F.size(u).alias("k")))
    rows = rows.where(sizes).withColumn("got", got).where(F.col("got.x") * K >= shared_at_least(K, percent) * F.col("got.k"))
    return rows.select("a", "b", (F.col("got.x") / F.col("got.k")).alias("est"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    rows = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    rows = rows.withColumn("x", F.size(F.array_intersect("set_a", "set_b")))
    return rows.where(100 * F.col("x") >= percent * (F.size("set_a") + F.size("set_b") - F.col("x"))).select("a", "b")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def labelled(rows: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    """With the component of a node; a node without links is its own."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias(out))
    return rows.join(named, node, "left").withColumn(out, F.coalesce(out, node))


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = labelled(labelled(pairs, labels, "a", "c_a"), labels, "b", "c_b")
    return rows.where("c_a != c_b").drop("c_a", "c_b")


def mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of lists whose classes are in several components, with their component and the list's commonest."""
    rows = labelled(lists, labels, "node", "c")
    groups = rows.groupBy("value", "c").agg(F.count(F.lit(1)).alias("g"))
    mixed = groups.groupBy("value").agg(F.max_by("c", F.struct("g", "c")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    return rows.join(mixed, "value")


def apart(tables: Tables, lists: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of a list whose classes are in different components and can link. Classes that such lists name meet
    again in lists of their whole sets, where few but real partners do."""
    some = tables.written(mixed_lists(lists, labels).select("node").distinct(), "mixed")
    whole = sets.join(small(some), "node").select("node", F.size("set").cast("long").alias("n"), F.col("set").alias("sketch"))
    rows = tables.written(mixed_lists(inverted_lists(whole, WHOLE, percent), labels), "whole-lists", [some])
    x, y = (rows.select("value", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "k", "at", "c")], (F.col("c") == F.col("most")).alias(f"{p}_most")) for p in "xy")
    near = can_link(*[F.col(f"{p}_{c}") for p in "xy" for c in ("at", "k", "n")], WHOLE, percent)
    near = near & (F.col("x_c") != F.col("y_c")) & (F.col("y_most") | (F.col("x_node") < F.col("y_node")))
    pairs = x.where("NOT x_most").join(y, "value").where(near).select(*ordered(F.col("x_node"), F.col("y_node"))).distinct()
    return tables.written(pairs, "apart", [rows])


def spanning(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of each of the written lists with one of them: the one with the fewest rarer values, as a text
    that others are copies of has, then the least by a hash of list and class."""
    hub = lists.groupBy("value").agg(F.min(F.struct("at", F.xxhash64("value", "node").alias("h"), "node", "n", "k")).alias("hub"), F.count(F.lit(1)).alias("rows"))
    near = can_link(*[F.col(c) for c in ("at", "k", "n", "hub.at", "hub.k", "hub.n")], LONG_K, percent)
    rows = met(lists, hub, "value", "rows", lists.count())
    return rows.where((F.col("node") != F.col("hub.node")) & near).select(*ordered(F.col("node"), F.col("hub.node"))).distinct()


def sketched(tables: Tables, df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, n, node), and classes (node, n, sketch, one, least, rows): `one` is a row whose text stands for the class,
    `least` its smallest key. Where sets that differ share a node, the second hash goes into theirs."""
    base = tables.written(df.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), summary(F.col(text)).alias("s")).select("key", "hash", "s.*"), "sketches")
    of_one = F.struct(F.col("key").isNull().alias("no"), "key", "hash")
    several = base.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo != hi").select("node", F.lit(True).alias("clash"))
    if not several.isEmpty():
        named = base.join(several, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("clash")
        base = tables.written(named, "sketches", [base])
    classes = base.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(of_one).alias("one"), F.min("key").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = tables.written(classes, "classes")
    return tables.written(base.select("key", "n", "node"), "rows", [base]), classes


def components_of(tables: Tables, df: DataFrame, classes: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(node, label) of the classes that link with another."""
    few = inverted_lists(classes.select("node", "n", "sketch"), K, percent).select("node").distinct()
    wanted = few.join(classes, "node").select("node", F.col("one.key").alias("k"), F.col("one.hash").alias("h"))
    wanted = small(tables.written(wanted, "wanted"))  # so that texts of other rows stay where they are
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    rows = rows.join(wanted, (F.col("hash") == F.col("h")) & F.col("key").eqNullSafe(F.col("k")))
    rows = rows.select("node", shingle_set(F.col("text")).alias("set")).groupBy("node").agg(F.first("set").alias("set"))  # rows that repeat a key and a text
    sets = tables.written(rows, "sets")
    long = sets.select("node", F.size("set").cast("long").alias("n"), F.slice("set", 1, LONG_K).alias("sketch"))
    lists = tables.written(inverted_lists(long, LONG_K, percent), "lists")
    pairs = tables.written(estimated(spanning(lists, percent), classes, percent), "pairs")

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a"))
    links = tables.written(confirmed(best, sets, percent), "links")
    labels = components(links)
    rest = across(pairs, labels).join(best, ["a", "b"], "left_anti")
    links = tables.written(links.union(confirmed(rest, sets, percent)), "links", [links])
    tables.drop(labels)
    labels = components(links)
    left = apart(tables, lists, labels, sets, percent)
    more = tables.written(confirmed(estimated(left.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), classes, percent), sets, percent), "links", [left, lists, pairs])
    tables.drop(sets)
    if more.isEmpty():
        return labels
    tables.drop(labels)
    return components(links.union(more))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, tables: Tables | None = None) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row.

    Links: 100 * intersection >= percent * union of shingle sets (percent >= 80). component_id is the smallest key that
    can be reached; kept where it is the row's own. Texts with fewer than five words are one shingle; null and empty
    texts have none and link with nothing, not even each other. Rows of one key are rows of their own; among rows that
    share their component's smallest key all are kept. A null key is reached only if no other is. Other columns aren't
    read. An empty table gives an empty table. Very long texts are one row's array of 8 bytes a word."""
    tables = tables or Tables(df.sparkSession, "near-duplicates")
    base, classes = sketched(tables, df, key, text)
    labels = components_of(tables, df, classes, key, text, percent)
    classes = tables.written(classes.select("node", "least", "rows"), "least", [classes])

    members = classes.join(labels, "node")
    least = members.groupBy("label").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("members"))
    lowest = met(members.select("node", "label"), least, "label", "members", labels.count()).select("node", "lowest")
    found = classes.join(lowest, "node", "left").select("node", F.coalesce("lowest", "least").alias("found"), "rows")
    found = tables.written(found, "found", [classes, labels])

    rows = met(base.where("n > 0"), found, "node", "rows", base.count()).select("key", "n", "found")
    rows = rows.unionByName(base.where("n = 0").select("key", "n", F.col("key").alias("found")))
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("found").alias("component_id"), F.col("found").eqNullSafe(F.col("key")).alias("kept"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows that are kept, one of each group; all columns stay. Rows that repeat a key and a shingle set are one.
    Texts without words are in no group and all stay."""
    tables, found = (Tables(df.sparkSession, n) for n in ("deduplicated", "near-duplicates"))
    k, times, s, node = fresh(df, "k", "times", "s", "node")
    kept = near_duplicates(df.select(key, text), key, text, percent, found).where("kept")
    counts = tables.written(kept.groupBy(F.col(key).alias(k)).agg(F.count(F.lit(1)).alias(times)), "kept")
    found.clear()
    rows = df.join(small(counts), F.col(key).eqNullSafe(F.col(k)))
    single = rows.where(F.col(times) == 1).select(*df.columns)
    several = rows.where(F.col(times) > 1).withColumn(s, summary(F.col(text)))
    empty = several.where(F.col(f"{s}.n") == 0).select(*df.columns)
    several = several.where(F.col(f"{s}.n") > 0).withColumn(node, F.struct(F.col(f"{s}.node"), F.col(f"{s}.other"))).dropDuplicates([k, node]).select(*df.columns)
    return single.unionByName(several).unionByName(empty)
