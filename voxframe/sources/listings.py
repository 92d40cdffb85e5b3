"""Listings, stems, pairs and manifests."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EXTENSION = r"(?i)\.nii(\.gz)?$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The name without .nii or .nii.gz; null if it has neither."""
    name = basename(path)
    return F.when(name.rlike(_EXTENSION), F.regexp_replace(name, _EXTENSION, ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?i)(\.nii(?:\.gz)?)$", 1))


def derived_output(path: Column, remove: list[str], suffix: str) -> Column:
    """The stem without the given substrings, with a suffix and .nii.gz."""
    out = stem(path)
    for part in remove:
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.concat(out, F.lit(suffix + ".nii.gz"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and size of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"))


def keyword_filter(df: DataFrame, path: str, include: list[str] = (), exclude: list[str] = (), parent: str | None = None, extensions: list[str] = ()) -> DataFrame:
    """Paths that hold all of `include` and none of `exclude` (case folded), in a parent folder of
    that name, with one of the extensions; in order of the folded path."""
    low = F.lower(F.col(path))
    keep = F.lit(True)
    for word in include:
        keep &= low.contains(word.lower())
    for word in exclude:
        keep &= ~low.contains(word.lower())
    if parent is not None:
        keep &= F.regexp_extract(F.col(path), r"([^/\\]*)[/\\][^/\\]*$", 1) == parent
    if extensions:
        own = F.lit(False)
        for e in extensions:
            own |= low.endswith(e.lower())
        keep &= own
    return df.filter(keep).orderBy(low)


def pair_masks(scans: DataFrame, masks: DataFrame, suffix: str) -> DataFrame:
    """Each scan (path, key) with the one mask (path, key) whose key is the scan's and the suffix.

    None or several masks: `discovery_error` says so and the row is kept.
    """
    found = masks.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("mask"))
    out = scans.join(found, F.concat("key", F.lit(suffix)) == F.col("_key"), "left")
    error = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
    return out.select("key", F.col("path").alias("scan"), F.when(F.col("n") == 1, F.col("mask")).alias("mask"), error.alias("discovery_error"))


def require_pairs(pairs: DataFrame) -> DataFrame:
    """The strict reading: any scan without exactly one mask raises."""
    if bad := pairs.filter("discovery_error IS NOT NULL").limit(5).collect():
        raise ValueError("scans without a mask of their own: " + ", ".join(r["scan"] for r in bad))
    return pairs.drop("discovery_error")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, scan, mask of a manifest: CSV, JSON lines, a JSON list, or an object with cases or records.

    Relative paths belong to the manifest's folder; an id defaults to the row's
    number from 1. An empty manifest, missing fields, repeated scans or ids, and
    a scan that is its own mask raise.
    """
    if path.lower().endswith(".csv"):
        found = spark.read.option("header", True).option("multiLine", True).csv(path)
    else:
        row = "id string, scan string, mask string"
        listed = "array<struct<id: string, scan: string, mask: string>>"
        got = spark.read.schema(f"{row}, cases {listed}, records {listed}").option("multiLine", not path.lower().endswith(".jsonl")).json(path)
        found = got.select(F.explode(F.coalesce("cases", "records", F.array(F.struct("id", "scan", "mask")))).alias("r")).select("r.*")
    field = lambda n: F.nullif(F.col(n).cast("string"), F.lit("")) if n in found.columns else F.lit(None).cast("string")
    rows = found.select(*[field(n).alias(n) for n in ("id", "scan", "mask")]).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts, starts, total = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()), {}, 0
    for p, n in counts:  # a number for each part of the files
        starts[p], total = total, total + n
    if not total:
        raise ValueError("the manifest is empty")
    before = F.create_map(*[F.lit(x) for p, n in starts.items() for x in (p, n)])[part]
    rows = rows.withColumn("number", before + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
    if lacking := rows.filter("scan IS NULL OR mask IS NULL").agg(F.min("number")).first()[0]:
        raise ValueError(f"row {lacking} lacks scan or mask")
    base = path.rsplit("/", 1)[0]
    place = lambda c: F.when(F.col(c).startswith("/") | F.col(c).contains("://"), F.col(c)).otherwise(F.concat(F.lit(f"{base}/"), F.col(c)))
    out = rows.select(F.coalesce("id", F.col("number").cast("string")).alias("id"), place("scan").alias("scan"), place("mask").alias("mask"))
    for what in ("id", "scan"):
        if not out.groupBy(what).count().filter("count > 1").isEmpty():
            raise ValueError(f"repeated {what}")
    if not out.filter("scan = mask").isEmpty():
        raise ValueError("a scan is its own mask")
    return out


def subject_id(path: Column, explicit: Column | None = None, pattern: str | None = None) -> Column:
    """Explicit id, else a configured pattern's first group (or whole match), else BIDS sub-, else A and eight digits; folded,
    without sub-. Null if nothing matches."""
    name = basename(path)
    found = [explicit] if explicit is not None else []
    if pattern:
        found.append(F.regexp_extract(path, pattern, 1 if "(" in pattern.replace("(?:", "") else 0))
    found += [F.regexp_extract(name, r"(?:^|_)sub-([A-Za-z0-9]+)(?=[_.]|$)", 1), F.regexp_extract(name, r"^(A[0-9]{8})", 1)]
    got = F.coalesce(*[F.nullif(f, F.lit("")) for f in found])
    return F.regexp_replace(F.lower(got), r"^sub-", "")


def output_collisions(plans: DataFrame, output: str) -> DataFrame:
    """Outputs that several inputs would write, with their number."""
    return plans.groupBy(F.lower(output).alias("output")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unprotected(plans: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Planned rows whose key isn't among the protected inputs."""
    return plans.join(protected.select(key), key, "left_anti")
