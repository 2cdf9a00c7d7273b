"""Satellite patches as flat arrays, channel by channel: `pixels` holds channels x size x size values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import WIDTH, known_around

THERMAL_BASE, THERMAL_SPAN = 180.0, 150.0


def archive_pairs(paths: DataFrame) -> DataFrame:
    """(stamp, plain, hrv): the time in a file name, for which both a plain and an hrv file exist; the first of each by path."""
    p = paths.select("path", F.regexp_extract("path", r"(\d{8}\d{4})", 1).alias("stamp"), F.when(F.col("path").contains("hrv"), "hrv").otherwise("plain").alias("kind"))
    wide = p.where("stamp != ''").groupBy("stamp").pivot("kind", ["plain", "hrv"]).agg(F.min("path"))
    return wide.where("plain IS NOT NULL AND hrv IS NOT NULL")


def join_sidecars(sidecars: DataFrame, patches: DataFrame) -> DataFrame:
    """Sidecar rows with the array of the same base name; those without one are left out."""
    base = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[A-Za-z]+)?$", 1)
    return sidecars.withColumn("__base", base("path")).join(patches.withColumn("__base", base("array_path")), "__base").drop("__base")


def channel(pixels: str, c: int, area: int) -> Column:
    """One channel's pixels; those that are missing or not finite become NULL."""
    return F.transform(F.slice(pixels, c * area + 1, area), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def patch_features(patches: DataFrame, channels: int, area: int, visible: tuple[int, int], infrared: tuple[int, int], pixels: str = "pixels") -> DataFrame:
    """patches with the mean, std, min and max of each channel's finite pixels, missing_fraction,
    cloud_index and irradiance_proxy. visible and infrared are ranges [a, b) of channels.
    All is computed within the row: nothing is exploded or shuffled."""
    known = {c: F.filter(channel(pixels, c, area), lambda x: x.isNotNull()) for c in range(channels)}
    add = lambda a, x: a + x
    out = patches.withColumns({f"__k{c}": k for c, k in known.items()})
    n = {c: F.size(f"__k{c}") for c in known}
    mean = {c: F.try_divide(F.aggregate(f"__k{c}", F.lit(0.0), add), n[c]) for c in known}
    out = out.withColumns({f"mean_{c}": m for c, m in mean.items()})

    def std(c):
        square = F.aggregate(f"__k{c}", F.lit(0.0), lambda a, x: a + (x - F.col(f"mean_{c}")) * (x - F.col(f"mean_{c}")))
        return F.sqrt(F.try_divide(square, n[c]))

    out = out.withColumns({f"std_{c}": std(c) for c in known} | {f"min_{c}": F.array_min(f"__k{c}") for c in known} | {f"max_{c}": F.array_max(f"__k{c}") for c in known})
    missing = F.lit(1.0) - sum(n.values(), F.lit(0)) / (channels * area)

    def band(a, b):
        total = sum((F.aggregate(f"__k{c}", F.lit(0.0), add) for c in range(a, b)), F.lit(0.0))
        return F.try_divide(total, sum((n[c] for c in range(a, b)), F.lit(0)))

    vis, ir = band(*visible), band(*infrared)
    out = out.withColumns({"missing_fraction": missing, "cloud_index": F.try_divide(vis, ir + 1e-6), "irradiance_proxy": vis})
    return out.drop(*[f"__k{c}" for c in known])


def channel_stats(patches: DataFrame, channels: int, area: int, by: list[str] = (), pixels: str = "pixels") -> DataFrame:
    """(by, channel, mean, scale, patches) over the finite pixels of all patches; scale is the population
    deviation, 1e-6 at least. Each patch is reduced to sums for each channel before the shuffle."""
    flat = patches.select(*by, F.posexplode(F.array(*[F.filter(channel(pixels, c, area), lambda x: x.isNotNull()) for c in range(channels)])).alias("channel", "v"))
    add = lambda a, x: a + x
    sums = flat.select(*by, "channel", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), add).alias("s"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("s2"))
    out = sums.groupBy(*by, "channel").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.count("*").alias("patches"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    var = F.greatest(F.try_divide(F.col("s2"), F.col("n")) - mean * mean, F.lit(0.0))
    return out.select(*by, F.col("channel").cast("long").alias("channel"), mean.alias("mean"), F.greatest(F.sqrt(var), F.lit(1e-6)).alias("scale"), "patches")


def as_vectors(stats: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, means, scales): arrays in the order of channels; a channel without any pixel is an error."""
    whole = F.when(F.count("mean") == F.count("*"), True).otherwise(F.raise_error(F.lit("a channel has no pixel")).cast("boolean"))
    rows = F.array_sort(F.collect_list(F.struct("channel", "mean", "scale")))
    out = stats.groupBy(*by).agg(rows.alias("r"), whole.alias("__whole")).where("__whole")
    return out.select(*by, F.transform("r", lambda x: x["mean"]).alias("means"), F.transform("r", lambda x: x["scale"]).alias("scales"))


def normalise(pixels: str, means: str, scales: str, area: int) -> Column:
    """(x - mean) / scale of each pixel's channel."""
    return F.transform(F.col(pixels), lambda x, i: (x - F.get(F.col(means), F.floor(i / area).cast("int"))) / F.get(F.col(scales), F.floor(i / area).cast("int")))


def physical(pixels: DataFrame, by: list[str], thermal: Column, value: str = "value") -> DataFrame:
    """Pixel rows in physical units: a thermal channel of a product whose maximum is 1 or less is a share of a span."""
    top = F.max(value).over(Window.partitionBy(*by))
    return pixels.withColumn(value, F.when(thermal & (top <= 1), THERMAL_BASE + THERMAL_SPAN * F.col(value)).otherwise(F.col(value)))


def select_channels(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of the listed channels with their place in the list, from 0."""
    places = rows.sparkSession.createDataFrame(list(enumerate(order)), "position int, channel string")
    return rows.join(F.broadcast(places), "channel")


def centre(pixels: str, channels: int, height: int, width: int, row: Column, column: Column, size: int) -> Column:
    """The size x size window around (row, column) of each channel, NULL outside the image."""
    half = size // 2

    def pick(k):
        c, r, q = F.floor(k / (size * size)), F.floor(k / size) % size + row - half, k % size + column - half
        inside = (r >= 0) & (r < height) & (q >= 0) & (q < width)
        return F.when(inside, F.get(F.col(pixels), (c * height * width + r * width + q).cast("int")))

    return F.transform(F.sequence(F.lit(0), F.lit(channels * size * size - 1)), pick)


def patch_status(pixels: str, expected: int) -> dict[str, Column]:
    """missing_fraction and status: invalid (wrong shape or infinite), missing (no finite pixel), degraded or ok."""
    finite = F.size(F.filter(pixels, lambda x: x.isNotNull() & ~F.isnan(x)))
    infinite = F.exists(pixels, lambda x: F.abs(x) == float("inf"))
    share = F.lit(1.0) - finite / F.lit(expected)
    status = F.when((F.size(pixels) != expected) | F.coalesce(infinite, F.lit(False)), "invalid").when(finite == 0, "missing").when(finite < expected, "degraded").otherwise("ok")
    return {"missing_fraction": share, "status": status}


def nearest_pixel(lats: str, lons: str, lat, lon) -> Column:
    """Flat index of the pixel nearest to a place by squared degrees, the first of equals; NULL where the place isn't known."""
    square = lambda x: x * x
    d = F.zip_with(lats, lons, lambda a, b: square(a - F.col(lat)) + square(b - F.col(lon)))
    return F.array_position(d, F.array_min(d)) - 1


def site_features(products: DataFrame, channels: int, height: int, width: int, size: int, visible: tuple[int, int], infrared: tuple[int, int], variant: str = "physical") -> DataFrame:
    """The site's patch of each product, checked, with its features and where it came from.

    products: (product_id, ts as text, pixels, lats, lons for each pixel, lat, lon of the site, and for the
    variant `normalised` means and scales by channel). The window lies around the pixel nearest to the site,
    or in the middle of the image if the place isn't known. A product whose time isn't UTC or whose image has
    another shape fails: status `failed`, a reason, NULL features; nothing is raised.
    """
    if variant not in ("physical", "normalised"):
        raise ValueError(f"unknown variant {variant}")
    pixel = F.coalesce(nearest_pixel("lats", "lons", "lat", "lon"), F.lit(height // 2 * width + width // 2))
    utc = F.coalesce(F.col("ts").rlike(r"(Z|[+]00:00)$"), F.lit(False))
    shaped = F.coalesce(F.size("pixels") == channels * height * width, F.lit(False))
    reason = F.when(~utc, "time is not UTC").when(~shaped, "wrong shape")
    p = products.withColumns({"pixel": pixel.cast("long"), "reason": reason})
    window = F.when(F.col("reason").isNull(), centre("pixels", channels, height, width, F.floor(F.col("pixel") / width), F.col("pixel") % width, size))
    p = p.withColumn("pixels", window)
    status = F.when(F.col("reason").isNotNull(), "failed").otherwise(patch_status("pixels", channels * size * size)["status"])
    p = p.withColumn("status", status)
    if variant == "normalised":
        p = p.withColumn("pixels", normalise("pixels", "means", "scales", size * size))
    origin = F.struct(F.col("product_id").alias("product"), F.col("pixel"), F.lit(variant).alias("variant"))
    return patch_features(p, channels, size * size, visible, infrared).withColumn("provenance", origin)


def projection_matrix(inputs: int, outputs: int, seed: int = 7) -> list[list[float]]:
    """A fixed random matrix by a seed."""
    return (np.random.default_rng(seed).standard_normal((inputs, outputs)) / np.sqrt(inputs)).tolist()


def project(means: Column, matrix: list[list[float]]) -> Column:
    """An array of channel means (missing ones count as 0) times a fixed matrix."""
    columns = list(zip(*matrix))
    zero = F.transform(means, lambda x: F.coalesce(x, F.lit(0.0)))
    dot = lambda w: F.aggregate(F.zip_with(zero, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[dot(w) for w in columns])


def nearest_axis(target: DataFrame, source: DataFrame, value: str, width: float = WIDTH) -> DataFrame:
    """(t, s): for each target axis index the source index whose mean coordinate is nearest, the lowest of equals;
    NULL for a target without a coordinate. One sorted scan over both axes finds the source coordinates next to a
    target on either side, so no pairs are made; axes are cut in stretches of `width` of the coordinate."""
    own = F.struct(F.col("y"), F.col("s"))
    y = source.select(F.col("k").alias("s"), F.col(value).cast("double").alias("y")).where("y is not null").groupBy("y").agg(F.min("s").alias("s"))
    x = target.select(F.col("k").alias("t"), F.col(value).cast("double").alias("at"), F.lit(True).alias("asks"))
    both = x.unionByName(y.select(F.col("y").alias("at"), own.alias("own")), allowMissingColumns=True).withColumn("all", F.lit(0))
    near = known_around(both, ["all"], "at", {"below": F.col("own")}, {"above": F.col("own")}, width).where("asks and at is not null")
    off = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.y")).alias("d"), F.col(f"{c}.s").alias("s")))
    found = near.select("t", F.least(off("below"), off("above")).getField("s").alias("s"))
    return found.unionByName(x.where("at is null").select("t", F.lit(None).cast(found.schema["s"].dataType).alias("s")))


def fill_missing(frame: DataFrame, defaults: dict[str, float]) -> DataFrame:
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))).cast("float") for c, v in defaults.items()})


def alignment_summary(aligned: DataFrame, by: str, matched: str = "matched_ts") -> DataFrame:
    """(by, rows, matched, rate), with by NULL for all."""
    return aligned.rollup(by).agg(F.count("*").alias("rows"), F.count(matched).alias("matched"), (F.count(matched) / F.count("*")).alias("rate"))


def encode_batches(patches: DataFrame, encoder, pixels: str = "pixels", out: str = "embedding") -> DataFrame:
    """patches with encoder(matrix of rows by pixels) as arrays. The encoder goes to the tasks once and takes Arrow batches."""
    shared = patches.sparkSession.sparkContext.broadcast(encoder)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = shared.value
        for x in batches:
            yield pd.Series(list(np.asarray(run(np.stack(x.to_numpy())), float)))

    return patches.withColumn(out, encode(F.transform(pixels, lambda x: F.coalesce(x, F.lit(0.0)))))
