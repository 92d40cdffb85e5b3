"""How a scan is dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files, dealt over all cores where it has fewer parts than these; else as it is, without a shuffle.

    Small tables lie in one file, which one task would read and then compute on
    alone. Only for plain scans: their parts are known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Rows of a narrow table that one task of a sort or an aggregation should get.
ROWS = 250_000


def parts_for(rows: DataFrame) -> int:
    """How many parts hold ROWS each, or the session's number if that is more; rows should be a plain scan, whose count comes from the files' footers.

    A number that is given isn't made smaller by Spark's adaptive plans, which go by compressed bytes.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
