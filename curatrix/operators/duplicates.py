"""Exact copies, first occurrences, near pairs by bands of hash bits, and the last value before each time."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.semantics import hamming, let
from curatrix.operators.graph import connected_components
from curatrix.operators.numbering import numbered
from curatrix.sources.shared import materialize


def exact_groups(items: DataFrame, key: str = "sha") -> DataFrame:
    """key, first (least item), n of each key that two items or more have; partial sums, so a hot key costs a row for each task."""
    return items.groupBy(key).agg(F.min("item_id").alias("first"), F.count("*").alias("n")).filter("n >= 2")


def numbered_groups(groups: DataFrame) -> DataFrame:
    """groups with group_id, in the order of their first items (which is the order of their member lists: groups are disjoint)."""
    return numbered(groups, "first", name="_g").withColumn("group_id", F.format_string("duplicate-group-%04d", "_g")).drop("_g")


def representatives(items: DataFrame, rank: list[Column], key: str = "sha") -> DataFrame:
    """item_id, representative, n, role of each member of an exact group; the representative is the first by rank.

    The pick is a minimum over structs, which Spark aggregates partially; members are joined back to it.
    """
    order = F.struct(*(c.alias(f"r{i}") for i, c in enumerate(rank)), F.col("item_id"))
    picked = items.groupBy(key).agg(F.min(order).alias("p"), F.count("*").alias("n")).filter("n >= 2").select(key, F.col("p.item_id").alias("representative"), "n")
    return items.select("item_id", key).join(picked, key).select("item_id", "representative", "n", F.when(F.col("item_id") == F.col("representative"), "representative").otherwise("candidate").alias("role"))


def first_occurrence(items: DataFrame, key: str = "sha") -> DataFrame:
    """item_id and the earlier item with the same key, for all but the first of each."""
    return items.select("item_id", key).join(exact_groups(items, key).drop("n"), key).filter("item_id <> first").select("item_id", F.col("first").alias("exact_duplicate_of"))


def pack_bits(values: Column) -> Column:
    """A long whose bit i is set where values[i]; the sum of distinct powers, the last as the sign."""
    return F.aggregate(F.transform(values, lambda b, i: F.when(b, F.expr("1L")).otherwise(F.expr("0L"))), F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("i")), lambda a, b: F.struct((a["v"].bitwiseOR(F.call_function("shiftleft", b, a["i"]))).alias("v"), (a["i"] + 1).alias("i")), lambda a: a["v"])


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(v)


def average_hash(v: Column, mean: Column) -> Column:
    """Bit i: value i is at least the mean."""
    return pack_bits(F.transform(v, lambda x: x.cast("double") >= mean))


def difference_hash(vector: str, width: int = 8) -> Column:
    """Bit of each cell but a row's last: its right neighbour is greater."""
    v = F.col(vector)
    places = F.filter(F.sequence(F.lit(0), F.size(v) - 2), lambda i: i % width != width - 1)
    return pack_bits(F.transform(places, lambda i: F.get(v, i + 1) > F.get(v, i)))


def hashed(vectors: DataFrame, vector: str = "embedding", width: int = 8) -> DataFrame:
    """vectors with mean, ahash, dhash and std."""
    v = F.col(vector)
    spread = lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m)) / F.size(v))
    made = let(mean_of(v), lambda m: F.struct(m.alias("mean"), average_hash(v, m).alias("ahash"), spread(m).alias("std")))
    return vectors.withColumn("_h", made).select(*vectors.columns, "_h.*", difference_hash(vector, width).alias("dhash"))


def correlation(a: Column, b: Column, ma: Column, mb: Column, mad: Column) -> Column:
    """Pearson's r of two arrays; flat ones correlate fully if they are close and not at all otherwise."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x.cast("double") - ma).alias("x"), (y.cast("double") - mb).alias("y")))
    s = F.aggregate(pairs, F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")), lambda t, p: F.struct((t["xy"] + p["x"] * p["y"]).alias("xy"), (t["xx"] + p["x"] * p["x"]).alias("xx"), (t["yy"] + p["y"] * p["y"]).alias("yy")))
    below = F.sqrt(s["xx"] * s["yy"])
    return F.when(below <= 1e-12, F.when(mad <= 0.01, 1.0).otherwise(0.0)).otherwise(s["xy"] / below)


def mean_abs(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x) / F.size(a)


def rms(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x) / F.size(a))


def vector_classes(vectors: DataFrame, vector: str = "embedding", item: str = "vec_id") -> DataFrame:
    """v and id, the least item, of each different vector; copies cost a row for each task, however many there are."""
    return vectors.groupBy(F.col(vector).alias("v")).agg(F.min(item).alias("id"))


def class_members(vectors: DataFrame, vector: str = "embedding", item: str = "vec_id") -> DataFrame:
    """item_id and id, the least item with the same vector, of every item."""
    return vectors.select(F.col(item).alias("item_id"), F.col(vector).alias("v")).join(vector_classes(vectors, vector, item), "v").select("item_id", "id")


def _bands(code: str, n: int) -> list[Column]:
    """The code's 64 bits cut into n runs, as longs."""
    edges = [64 * i // n for i in range(n + 1)]
    return [F.expr(f"shiftrightunsigned(shiftleft({code}, {64 - hi}), {64 - hi + lo})") for lo, hi in zip(edges, edges[1:], strict=False)]


def _keys(columns: list[Column]) -> Column:
    """A row for each of the keys, with its number."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("b"), k.alias("bits")) for i, k in enumerate(columns))))


def near_pairs(vectors: DataFrame, ahash: int = 3, dhash: int = 4, corr: float = 0.965, mad: float = 0.05, rms_most: float = 0.075, std_least: float = 0.025, vector: str = "embedding", item: str = "vec_id") -> DataFrame:
    """first, second and their distances, for all pairs of different vectors within every bound.

    Equal vectors are no near pair (they are exact copies); each is stood for by its least item (class_members has the
    others). Hashes at most `ahash` bits apart agree in one of ahash + 1 bands, and likewise `dhash` (pigeonhole), so pairs
    are found by an equi-join on a band of both, which loses none. Flat vectors only meet those that aren't, as two of them
    are never a pair. Bits are compared before arrays are.
    """
    rows = materialize(hashed(vector_classes(vectors, vector, item), "v").select("id", "v", "mean", "ahash", "dhash", "std"), "hashes")
    keys = [F.xxhash64(F.lit(i), a, d) for i, (a, d) in enumerate(product(_bands("ahash", ahash + 1), _bands("dhash", dhash + 1)))]
    keyed = rows.select("id", "ahash", "dhash", (F.col("std") < std_least).alias("flat"), _keys(keys).alias("k")).select("id", "ahash", "dhash", "flat", "k.*")
    x, y = (keyed.select(*(F.col(c).alias(f"{c}{s}") for c in ("id", "ahash", "dhash", "flat")), "b", "bits") for s in "12")
    near = x.join(y.filter("NOT flat2"), ["b", "bits"]).filter((F.col("flat1") | (F.col("id1") < F.col("id2"))) & (hamming("ahash1", "ahash2") <= ahash) & (hamming("dhash1", "dhash2") <= dhash))
    pairs = near.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), hamming("ahash1", "ahash2").cast("long").alias("ahash_distance"), hamming("dhash1", "dhash2").cast("long").alias("dhash_distance")).distinct()
    one, two = (rows.select(F.col("id").alias(f"id{s}"), F.col("v").alias(f"v{s}"), F.col("mean").alias(f"m{s}")) for s in "12")
    both = pairs.join(one, "id1").join(two, "id2").withColumn("mad", mean_abs(F.col("v1"), F.col("v2"))).withColumn("rms", rms(F.col("v1"), F.col("v2")))
    both = both.withColumn("corr", correlation(F.col("v1"), F.col("v2"), F.col("m1"), F.col("m2"), F.col("mad")))
    return both.filter((F.col("corr") >= corr) & (F.col("mad") <= mad) & (F.col("rms") <= rms_most)).select(F.col("id1").alias("first"), F.col("id2").alias("second"), "ahash_distance", "dhash_distance", "corr", "mad", "rms")


def crop_agrees(pairs: DataFrame, crops: DataFrame, corr: float = 0.975, mad: float = 0.040) -> DataFrame:
    """Those pairs (first, second) whose center crops (id, v) agree too: the second check of near duplicates."""
    mean = crops.select("id", "v", mean_of(F.col("v")).alias("m"))
    one, two = (mean.select(F.col("id").alias(k), F.col("v").alias(f"v{s}"), F.col("m").alias(f"m{s}")) for s, k in (("1", "first"), ("2", "second")))
    both = pairs.join(one, "first").join(two, "second").withColumn("crop_mad", mean_abs(F.col("v1"), F.col("v2")))
    both = both.withColumn("crop_corr", correlation(F.col("v1"), F.col("v2"), F.col("m1"), F.col("m2"), F.col("crop_mad")))
    return both.filter((F.col("crop_corr") >= corr) & (F.col("crop_mad") <= mad)).select(*pairs.columns, "crop_corr", "crop_mad")


def center_crop(vector: Column, width: int = 8, border: int = 1) -> Column:
    """A grid's cells but `border` of them at each side."""
    inside = F.filter(F.sequence(F.lit(0), F.size(vector) - 1), lambda i: (i % width >= border) & (i % width < width - border) & (i >= border * width) & (i < F.size(vector) - border * width))
    return F.transform(inside, lambda i: F.get(vector, i))


def near_groups(pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """item_id, component, n, confidence of each item of a pair, and of its copies by members (item_id, id).

    The confidence is that of the component's weakest pair.
    """
    nodes = connected_components(pairs, "first", "second")
    weakest = pairs.join(nodes, pairs["first"] == nodes["node"]).groupBy("component").agg(F.min("corr").alias("corr"))
    every = nodes.withColumnRenamed("node", "item_id") if members is None else members.join(nodes, members["id"] == nodes["node"]).select("item_id", "component")
    sizes = every.groupBy("component").agg(F.count("*").alias("n"))
    confidence = F.round(F.greatest(F.lit(0.60), F.least(F.lit(0.82), F.col("corr") - 0.18)), 4)
    return every.join(sizes, "component").join(weakest, "component").select("item_id", "component", "n", confidence.alias("confidence"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before its time, by key: one union, one sort for each key, no pairs."""
    both = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", F.col("_last").alias(f"as_of_{value}"))
