"""Which record stands in for one that can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bucket, and buckets of a bucket above it.
BUCKET = 4096


def _later(rows: DataFrame, size: int, places: int) -> DataFrame:
    """(at, later) from (at, found), at from 0 to below `places`: the least find strictly after each place.

    Within buckets of `size` places by a window, beyond a bucket's end by the same
    question for buckets, so no window holds more than that, however many places there are.
    """
    if places <= size:
        return rows.select("at", F.min("found").over(Window.orderBy("at").rangeBetween(1, Window.unboundedFollowing)).alias("later"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / size))
    above = _later(rows.groupBy(F.col("bucket").alias("at")).agg(F.min("found").alias("found")), size, -(-places // size))
    inside = F.min("found").over(Window.partitionBy("bucket").orderBy("at").rangeBetween(1, Window.unboundedFollowing))
    met = rows.withColumn("inside", inside).join(above.withColumnRenamed("at", "bucket"), "bucket")
    return met.select("at", F.coalesce("inside", "later").alias("later"))


def next_readable(records: DataFrame, place: str = "idx", readable: str = "readable", size: int = BUCKET) -> DataFrame:
    """The records with `stand_in`: the place of the first readable one at or after theirs, from the start again beyond the end.

    Null for all if none can be read, which a caller should take for a fault of
    the whole set, and for a record with a null place. A null `readable` counts
    as false. Of several records at a place one that can be read is enough. An
    empty table gives no rows; other columns stay.
    """
    at, good = F.col(place).cast("long"), F.coalesce(F.col(readable), F.lit(False))
    low, high, first = records.agg(F.min(at), F.max(at), F.min(F.when(good, at))).first()
    if first is None:
        return records.withColumn("stand_in", F.lit(None).cast("long"))
    places = records.filter(at.isNotNull()).groupBy((at - low).alias("at")).agg(F.min(F.when(good, at)).alias("found"))
    later = _later(places, size, high - low + 1)
    own = places.join(later, "at").select((F.col("at") + low).alias(place), F.coalesce("found", "later", F.lit(first)).alias("stand_in"))
    return records.withColumn("_place", at).join(own.withColumnRenamed(place, "_place"), "_place", "left").drop("_place")
