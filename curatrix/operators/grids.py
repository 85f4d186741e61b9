"""Pixel kernels on tables (id, y, x, v): neighbours are frames over an image's rows and columns, which are of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row():
    """Along a row of an image."""
    return Window.partitionBy("id", "y").orderBy("x")


def column():
    return Window.partitionBy("id", "x").orderBy("y")


#: A task makes so many pixels, more or less.
PIXELS = 1 << 20


def grid(ids: DataFrame, height: int, width: int, value: str) -> DataFrame:
    """Generated pixels of an image for each of ids (id): value is SQL over id, y and x.

    Ids are dealt before their pixels are made, so frames over an image's rows and columns need no shuffle.
    """
    tasks = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() * height * width // PIXELS))
    cells = ids.select("id").repartition(tasks, "id").select("id", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("_c"))
    return cells.selectExpr("id", f"cast(_c DIV {width} AS long) AS y", f"cast(_c % {width} AS long) AS x").withColumn("v", F.expr(value))


def gray(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Luminance of BT.601."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return 0.299 * c(r) + 0.587 * c(g) + 0.114 * c(b)


def _three(value: str, w) -> Column:
    v = F.col(value)
    return F.coalesce(F.lag(value).over(w), v) + v + F.coalesce(F.lead(value).over(w), v)


def box_blur(df: DataFrame) -> DataFrame:
    """Mean of each 3 x 3 neighbourhood, edges repeated."""
    return df.withColumn("_h", _three("v", row()) / 3).withColumn("blur", _three("_h", column()) / 3).drop("_h")


def dilated(df: DataFrame, radius: int) -> DataFrame:
    """The greatest v of the square of that radius."""
    frame = lambda w: w.rowsBetween(-radius, radius)
    return df.withColumn("_h", F.max("v").over(frame(row()))).withColumn("dilated", F.max("_h").over(frame(column()))).drop("_h")


def laplacian(df: DataFrame) -> DataFrame:
    """4 v less the four neighbours, inside the border."""
    near = [f("v").over(w) for w in (row(), column()) for f in (F.lag, F.lead)]
    out = df.withColumn("laplacian", 4 * F.col("v") - near[0] - near[1] - near[2] - near[3])
    return out.filter(F.col("laplacian").isNotNull())


def blocking(df: DataFrame, block: int = 8) -> DataFrame:
    """id, ratio, score: the mean step at block edges, alone (score) and against all other steps, in both directions."""
    steps = df.select("id", "x", "y", F.abs(F.col("v") - F.lag("v").over(row())).alias("h"), F.abs(F.col("v") - F.lag("v").over(column())).alias("w"))
    each = steps.select("id", F.explode(F.array(F.struct((F.col("x") % block == 0).alias("edge"), F.col("h").alias("d")), F.struct((F.col("y") % block == 0).alias("edge"), F.col("w").alias("d")))).alias("s")).filter("s.d IS NOT NULL")
    mean = lambda e: F.avg(F.when(F.col("s.edge") == e, F.col("s.d")))
    out = each.groupBy("id").agg(mean(True).alias("at"), mean(False).alias("off"))
    return out.select("id", (F.col("at") / F.greatest(F.col("off"), F.lit(0.25))).alias("ratio"), F.col("at").alias("score"))


def local_contrast(df: DataFrame, block: int) -> DataFrame:
    """id, contrast, consistency: mean spread within blocks, and how much it varies between them."""
    blocks = df.groupBy("id", F.expr(f"y DIV {block}").alias("by"), F.expr(f"x DIV {block}").alias("bx")).agg(F.stddev_pop("v").alias("s"))
    return blocks.groupBy("id").agg(F.avg("s").alias("contrast"), (100 * F.exp(-F.stddev_pop("s") / F.greatest(F.avg("s"), F.lit(1e-6)))).alias("consistency"))


def _steps(df: DataFrame) -> DataFrame:
    """Absolute steps to the left and upper neighbours, one row each; null at the border."""
    d = df.select("id", "v", F.abs(F.col("v") - F.lag("v").over(row())).alias("h"), F.abs(F.col("v") - F.lag("v").over(column())).alias("w"))
    return d.select("id", "v", F.explode(F.array("h", "w")).alias("d"))


def banding(df: DataFrame) -> DataFrame:
    """id, tones, tone_range, banding: few tones over a wide range with flat steps between; 0 among strong edges."""
    sums = _steps(df).groupBy("id").agg(F.countDistinct("v").alias("tones"), (F.max("v") - F.min("v")).alias("tone_range"), F.avg((F.col("d") <= 0.75).cast("double")).alias("flat"), F.avg((F.col("d") >= 20).cast("double")).alias("strong"))
    pressure = 1 - F.col("tones") / F.greatest(F.lit(1), F.least(F.lit(256), F.col("tone_range").cast("int")))
    value = F.when((F.col("strong") > 0.03) | (F.col("tone_range") <= 0), 0.0).otherwise(0.55 * F.col("flat") + 0.45 * F.greatest(F.lit(0.0), pressure))
    return sums.select("id", "tones", "tone_range", "flat", value.alias("banding"))


def difference_hash(df: DataFrame) -> DataFrame:
    """id, hash: hex of one bit for each cell whose right neighbour is less, row by row, the first highest (at most 64 cells with one)."""
    bits = df.withColumn("b", F.col("v") > F.lead("v").over(row())).filter("b IS NOT NULL")
    rows = bits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("b").cast("int").alias("b")))).alias("bits"))
    text = F.array_join(F.transform("bits", lambda s: s["b"].cast("string")), "")
    return rows.select("id", text.alias("bits"))


def ringing(df: DataFrame, strong: int = 45, near: int = 2, far: int = 5) -> DataFrame:
    """id, ringing, mosquito: residuals beside strong edges, less those far from any; and how many beside them are large."""
    steps = box_blur(df).withColumn("r", F.abs(F.col("v") - F.col("blur")))
    edge = steps.withColumn("e", (F.coalesce(F.abs(F.col("v") - F.lag("v").over(row())), F.lit(0)) + F.coalesce(F.abs(F.col("v") - F.lag("v").over(column())), F.lit(0)) >= strong).cast("int"))
    for name, r in (("n", near), ("f", far)):
        edge = edge.withColumn("_h", F.max("e").over(row().rowsBetween(-r, r))).withColumn(name, F.max("_h").over(column().rowsBetween(-r, r)))
    beside = F.when((F.col("n") == 1) & (F.col("e") == 0), F.col("r"))
    sums = edge.groupBy("id").agg(F.avg(beside).alias("a"), F.coalesce(F.avg(F.when(F.col("f") == 0, F.col("r"))), F.avg("r")).alias("b"), F.avg((beside >= 8).cast("double")).alias("m"))
    return sums.select("id", F.coalesce(F.greatest(F.lit(0.0), F.col("a") - F.col("b")), F.lit(0.0)).alias("ringing"), F.coalesce("m", F.lit(0.0)).alias("mosquito"))


def chroma(df: DataFrame, r: Column, g: Column, b: Column, strong: int = 45, near: int = 2) -> DataFrame:
    """id, chroma: the 90th percentile of color residuals beside strong steps of v; 0 without any."""
    cb, cr = -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128
    both = df.withColumns({"cb": cb, "cr": cr})
    for c in ("cb", "cr"):
        both = both.withColumn("_h", _three(c, row()) / 3).withColumn(f"r{c}", F.abs(F.col(c) - _three("_h", column()) / 3)).drop("_h")
    step = F.coalesce(F.abs(F.col("v") - F.lag("v").over(row())), F.lit(0)) + F.coalesce(F.abs(F.col("v") - F.lag("v").over(column())), F.lit(0))
    zone = both.withColumn("e", (step >= strong).cast("int")).withColumn("_h", F.max("e").over(row().rowsBetween(-near, near))).withColumn("n", F.max("_h").over(column().rowsBetween(-near, near)))
    return zone.groupBy("id").agg(F.coalesce(F.percentile(F.when(F.col("n") == 1, F.col("rcb") + F.col("rcr")), F.lit(0.9)), F.lit(0.0)).alias("chroma"))


def color_statistics(df: DataFrame, r: Column, g: Column, b: Column) -> DataFrame:
    """id, brightness, saturation, contrast as shares of 100, two digits, from 8-bit channels."""
    gray_ = F.floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536)
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    saturation = F.when(most > 0, F.floor((most - least) * 255 / most)).otherwise(0)
    share = lambda x, of: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x / of * 100)), 2)
    return df.groupBy("id").agg(share(F.avg(gray_), 255).alias("brightness"), share(F.avg(saturation), 255).alias("saturation"), share(F.stddev_pop(gray_), 127.5).alias("contrast"))


def pixel_hash(df: DataFrame, *channels: Column, mode: str = "RGB") -> DataFrame:
    """id, pixel_hash: SHA-256 over mode, size and bytes of an image, which is of bounded size."""
    bytes_ = F.concat(*(F.lpad(F.hex(c.cast("long")), 2, "0") for c in channels))
    cells = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("y", "x", bytes_.alias("p")))).alias("c"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    head = F.concat(F.lit(mode), F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string")).cast("binary")
    return cells.select("id", F.sha2(F.concat(head, F.lit(b"\0"), F.unhex(F.array_join(F.transform("c", lambda s: s["p"]), ""))), 256).alias("pixel_hash"))


def encoding_measures(df: DataFrame, r: Column, g: Column, b: Column, files: DataFrame) -> DataFrame:
    """Everything that the encoding rules judge, a row for each image: files (id, is_jpeg, jpeg_quality, file_size) and its pixels' measures."""
    shape = df.groupBy("id").agg(F.count("*").alias("pixels"), F.least(F.max("x") + 1, F.max("y") + 1).alias("least_side"))
    block = blocking(df).select("id", F.round("ratio", 4).alias("block_ratio"), F.round("score", 4).alias("block_score"))
    noise = ringing(df).select("id", F.round("ringing", 4).alias("ringing"), F.round("mosquito", 6).alias("mosquito"))
    tone = banding(df).select("id", F.round("banding", 4).alias("banding"), "tones", "tone_range")
    color = chroma(df, r, g, b).select("id", F.round("chroma", 4).alias("chroma"))
    joined = files.join(shape, "id").join(block, "id").join(noise, "id").join(tone, "id").join(color, "id")
    return joined.withColumn("bytes_per_pixel", F.round(F.col("file_size") / F.greatest(F.lit(1), F.col("pixels")), 6))


def robust_outliers(df: DataFrame, least: float = 26.0, k: float = 6.0) -> DataFrame:
    """id, threshold, n: cells above the greater of `least` and the median plus k median deviations.

    Both medians are frames over an image's cells, so none is joined to them.
    """
    image = Window.partitionBy("id")
    off = df.filter("id IS NOT NULL").withColumn("m", F.median("v").over(image))
    bound = off.withColumn("threshold", F.greatest(F.lit(least), F.col("m") + k * F.median(F.abs(F.col("v") - F.col("m"))).over(image)))
    return bound.groupBy("id", "threshold").agg(F.sum((F.col("v") > F.col("threshold")).cast("long")).alias("n"))
