"""Volumes as rows: from embedding tables and from NIfTI files."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.tasks import spread

VOLUME = "case_id string, shape array<int>, spacing_mm array<double>, affine array<double>, voxels array<double>, error string"


def embedding_volumes(spark: SparkSession, sf_dir: str, normalized: bool = True) -> DataFrame:
    """Each vector of 64 values as a 4 x 4 x 4 volume; the mask is what lies above the median."""
    rows = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(F.col("vec_id").alias("case_id"), "label", F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), F.transform("embedding", lambda x: x.cast("double")).alias("voxels"))
    if normalized:
        rows = rows.withColumn("voxels", normalize_intensity(F.col("voxels")))
    masked = A.let(lambda v: F.struct(v.alias("voxels"), A.let(lambda m: F.transform(v, lambda x: x > m), A.median(v)).alias("mask")), F.col("voxels"))
    return rows.withColumn("_v", masked).select("case_id", "label", "shape", "_v.*")


def normalize_intensity(voxels):
    """To [0, 1]. Not finite: NaN counts as 0, infinities as the greatest or least finite value.
    More than 1 % negative: between the 1st and 99th percentile (least and greatest if equal, zeros if flat);
    otherwise clipped at the 99th percentile of the positives and divided by it."""
    inf = float("inf")

    def finite(raw, good):
        most, least = F.coalesce(F.array_max(good), F.lit(0.0)), F.coalesce(F.array_min(good), F.lit(0.0))
        return A.let(lambda m, n: F.transform(raw, lambda x: F.when(F.isnan(x), 0.0).when(x == inf, m).when(x == -inf, n).otherwise(x)), most, least)

    def by_range(v, low, high):
        flat = high <= low
        low, high = F.when(flat, F.array_min(v)).otherwise(low), F.when(flat, F.array_max(v)).otherwise(high)
        return A.let(lambda a, b: F.transform(v, lambda x: F.when(b > a, A.clip((x - a) / (b - a))).otherwise(0.0)), low, high)

    def by_top(v, top):
        return F.transform(v, lambda x: F.when(top.isNull(), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), top) / (top + 1e-8)))

    def scaled(v):
        signed = F.size(F.filter(v, lambda x: x < 0)) > 0.01 * F.size(v)
        ranged = A.let(lambda a, b: by_range(v, a, b), A.percentile(v, 1.0), A.percentile(v, 99.0))
        return F.when(signed, ranged).otherwise(A.let(lambda t: by_top(v, t), A.percentile(A.positives(v), 99.0)))

    clean = A.let(finite, voxels, F.filter(voxels, lambda x: ~F.isnan(x) & (F.abs(x) < inf)))
    return A.let(scaled, clean)


def zscore(voxels, mask=None):
    """(v - mean) / (std + 1e-8) over the mask, else over the positives, else over all."""
    region = A.positives(voxels)
    if mask is not None:
        inside = A.where(voxels, mask, lambda x, m: m)
        region = F.when(F.exists(mask, lambda m: m), inside).otherwise(region)
    region = A.let(lambda r: F.when(F.size(r) > 0, r).otherwise(voxels), region)
    return A.let(lambda r: A.let(lambda m, s: F.transform(voxels, lambda x: (x - m) / (s + 1e-8)), A.mean(r), A.std(r)), region)


# The voxel types of the NIfTI-1 header.
_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_UNITS = {0: 1.0, 1: 1000.0, 2: 1.0, 3: 0.001}


def decode_nifti(data: bytes, header_only: bool = False) -> dict:
    """Shape, affine, spacing in mm and voxels of a NIfTI-1 file, gzipped or not.

    Trailing axes of length 1 are dropped; anything but three axes, a bad shape
    or a singular affine raises.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if len(data) < 348 or struct.unpack_from(order + "i", data)[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", data, 40)
    shape = list(dim[1 : 1 + dim[0]])
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    if len(shape) != 3 or min(shape) < 1:
        raise ValueError(f"not a volume: {shape}")
    kind = struct.unpack_from(order + "h", data, 70)[0]
    if kind not in _TYPES:
        raise ValueError(f"voxel type {kind}")
    pixdim = struct.unpack_from(order + "8f", data, 76)
    at, slope, inter = struct.unpack_from(order + "3f", data, 108)
    unit = _UNITS.get(data[123] & 7, 1.0)
    q, s = struct.unpack_from(order + "2h", data, 252)
    affine = np.eye(4)
    if s > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", data, 280)).reshape(3, 4)
    elif q > 0:
        b, c, d, *offset = struct.unpack_from(order + "6f", data, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        rotation = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = rotation * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
        affine[:3, 3] = offset
    else:
        affine[:3, :3] = np.diag(pixdim[1:4])
    affine[:3] *= unit
    if not np.isfinite(affine).all() or abs(np.linalg.det(affine[:3, :3])) < 1e-12:
        raise ValueError("affine is not finite or singular")
    out = {"shape": shape, "affine": affine.ravel(), "spacing_mm": np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), "voxels": None}
    if not header_only:
        raw = np.frombuffer(data, order + _TYPES[kind], int(np.prod(shape)), int(at)).astype(np.float64)
        if slope not in (0.0, 1.0) or inter:
            raw = raw * (slope or 1.0) + inter
        out["voxels"] = raw.reshape(shape, order="F").ravel()
    return out


def _first_bytes(uri: str, size: int = 352) -> bytes:
    """The beginning of a file, unzipped if it is gzipped; no more than a block of it is read."""
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        source = open(unquote(where.path), "rb")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        source = store.open_input_stream(path)
    with source:
        data = source.read(4096)
        return zlib.decompressobj(31).decompress(data, size) if data[:2] == b"\x1f\x8b" else data[:size]


def encode_nifti(voxels: np.ndarray, affine: np.ndarray) -> bytes:
    """A NIfTI-1 file of a volume, uint8 for masks and float32 otherwise."""
    kind, bits, data = (2, 8, voxels.astype("u1")) if voxels.dtype == bool else (16, 32, voxels.astype("<f4"))
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *voxels.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, kind, bits)
    struct.pack_into("<8f", head, 76, 1, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[123] = 2
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + data.tobytes(order="F")


def read_nifti(spark: SparkSession, path: str, glob: str = "*.nii*", header_only: bool = False, mode: str = "raw") -> DataFrame:
    """One row for each file below a folder, with `error` where it can't be read.

    mode 'raw': values as they are; 'binary': must be 0 or 1; 'reference': finite
    in [0, 1], then 1 where above 0.5 as float32. With `header_only` voxels are
    null and only the beginning of each file is read, by the URI that Spark lists.
    """
    if mode not in ("raw", "binary", "reference"):
        raise ValueError(f"unknown mode {mode!r}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                row = {"case_id": r.path, "shape": None, "spacing_mm": None, "affine": None, "voxels": None, "error": None}
                try:
                    got = decode_nifti(_first_bytes(r.path) if header_only else r.content, header_only)
                    v = got["voxels"]
                    if v is not None and mode != "raw":
                        if not np.isfinite(v).all() or v.min() < 0 or v.max() > 1 or (mode == "binary" and not np.isin(v, (0, 1)).all()):
                            raise ValueError("not a mask")
                        got["voxels"] = (v.astype(np.float32) > 0.5).astype(float)
                    row |= got
                except Exception as e:  # noqa: BLE001  (a file that can't be read is a row, not a failed job)
                    row["error"] = str(e)
                yield pd.DataFrame([row])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", *([] if header_only else ["content"])).mapInPandas(read, VOLUME)
