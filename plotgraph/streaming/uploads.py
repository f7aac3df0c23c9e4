"""Bulk uploads as a stream: files of features in, registered plots and outcomes out.

Each micro-batch resolves its rows against what earlier batches registered and
against its own earlier rows, then appends.  A batch that is run again after a
failure finds its own plots by their hashes and reports ``exists``; plots are
never appended twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import cells, digests, geometry
from ..functions.lineage import cut
from ..operators import cover, registry, resolve

FEATURES = "row long, geometry string, declared_area double"
#: Points have a position, polygons the cells of their cover.
PLOTS = "geo_id string, content_hash string, row long, lat double, lng double, cells array<long>"


def identified(rows: DataFrame) -> DataFrame:
    """Point and polygon rows ``(row, geometry, declared_area)`` with content hash, area, why they can't be used, and position or canonical shape.

    A point is named by its leaf cell, a polygon here by its canonical text.
    """
    shape = geometry.from_geojson(F.col("geometry"))
    r = rows.withColumn("shape", shape)
    pin = F.coalesce(geometry.is_closed_point(F.col("shape")), F.lit(False))
    vertex = F.col("shape")[0][0][0]
    leaf = cells.id_to_token(cells.from_lat_lng(F.round(vertex[1], 6), F.round(vertex[0], 6)))
    point = F.sha2(F.concat_ws(" ", F.format_string("%.6f", vertex[0]), F.format_string("%.6f", vertex[1])), 256)
    r = r.withColumn("kind", F.when(pin, "point").otherwise("polygon"))
    unusable = F.when(F.col("shape").isNull(), "unparseable").when(~pin & (F.size(geometry.canonical(F.col("shape"))) == 0), "zero_area")
    polygon = geometry.content_hash(F.col("shape"))
    return r.select(
        "row", "kind", F.col("declared_area").alias("declared"), F.when(F.col("shape").isNotNull(), F.when(pin, point).otherwise(polygon)).alias("content_hash"),
        F.when(~pin & F.col("shape").isNotNull(), geometry.equal_area_acres(F.col("shape"))).alias("acres"), unusable.alias("unusable"),
        F.when(pin, digests.cover_digest(F.array(leaf))).otherwise(polygon).alias("geo_id"),
        F.when(pin, F.round(vertex[1], 6)).alias("lat"), F.when(pin, F.round(vertex[0], 6)).alias("lng"),
        F.when(~pin & F.col("shape").isNotNull(), geometry.canonical(F.col("shape"))).alias("shape"),
    )


def same_plots(fresh: DataFrame, covers: DataFrame, plots: DataFrame) -> DataFrame:
    """``row`` of the rows ``fresh(row, kind, lat, lng)`` that are the same plot as a registered one or as an earlier row that becomes one.

    Polygons are the same by the IoU of their covers, ``covers(owner, cell)`` by
    row, points by distance.  A nested plot is a plot of its own.
    """
    row, plot = F.concat(F.lit("row:"), F.col("row")), F.concat(F.lit("plot:"), F.col("geo_id"))
    mine = covers.select(F.concat(F.lit("row:"), F.col("owner")).alias("owner"), "cell")
    held = mine.unionByName(plots.select(plot.alias("owner"), F.explode("cells").alias("cell")))
    pairs = cut(resolve.candidates(mine, held))
    asked = held.join(pairs.select(F.col("b").alias("owner")).distinct(), "owner", "left_semi")
    same = resolve.verdicts(resolve.score(mine, asked, pairs)).filter("relation = 'same_as'")
    pins = fresh.filter("kind = 'point'").select(row.alias("geo_id"), "lat", "lng")
    near = resolve.near_points(pins, pins.unionByName(plots.filter("lat is not null").select(plot.alias("geo_id"), "lat", "lng")))
    near = near.filter("a <> b").select("a", "b", F.lit("same_as").alias("relation"), (-F.col("metres")).alias("score"))
    links = cut(same.unionByName(near))
    ids = fresh.select(row.alias("id"), F.col("row").alias("at")).unionByName(links.filter("b like 'plot:%'").select(F.col("b").alias("id"), F.lit(-(2**63)).alias("at")).distinct())
    decided = resolve.resolve_batch(ids, links).filter("outcome = 'same_as'").select("id")
    return fresh.select("row", row.alias("id")).join(decided, "id", "left_semi").select("row")


def register_batch(rows: DataFrame, plots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of ``rows``, and the plots to append to ``plots``."""
    named = cut(identified(rows))
    none = named.select("row").limit(0)
    fresh = cut(registry.registration_outcomes(named, plots, none).filter("outcome = 'created'").select("row").join(named, "row"))
    covers = cut(cover.polygon_cover(fresh.filter("kind = 'polygon'").select(F.col("row").alias("owner"), "shape")))
    outcomes = cut(registry.registration_outcomes(named, plots, same_plots(fresh, covers, plots)))
    created = outcomes.filter("outcome = 'created'").join(fresh, "row").join(covers.groupBy(F.col("owner").alias("row")).agg(F.collect_list("cell").alias("cells")), "row", "left")
    return outcomes, created.select("geo_id", "content_hash", "row", "lat", "lng", "cells")


def register_stream(spark: SparkSession, source: str, plots: str, outcomes: str, checkpoint: str) -> StreamingQuery:
    """Start registering all feature files under ``source`` (JSON lines of FEATURES), and stop when they are done.

    ``plots`` and ``outcomes`` are Parquet folders; the query's own checkpoint
    makes it resume where it stopped.
    """
    spark.createDataFrame([], PLOTS).write.mode("append").parquet(plots)
    stream = spark.readStream.schema(FEATURES).json(source)

    def batch(rows: DataFrame, number: int) -> None:
        known = spark.read.schema(PLOTS).parquet(plots)
        found, created = register_batch(rows, known)
        found = found.withColumn("batch", F.lit(number)).persist()
        # The outcomes come first: they read the plots as they were before this batch.
        found.write.mode("overwrite").parquet(f"{outcomes}/batch={number}")
        created.write.mode("append").parquet(plots)
        found.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
