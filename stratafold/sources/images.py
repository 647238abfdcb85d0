"""Images as tables: which files a look-alike search takes, their grey grids and perceptual hashes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.hashing import canonical_hash
from stratafold.functions.paths import casefold
from stratafold.functions.text import category
from stratafold.operators import clusters
from stratafold.operators.graph import number_vertices
from stratafold.operators.scan import cloud_only
from stratafold.session import cut
from stratafold.sources import inventory as I

#: Side of the grid that an image is reduced to.
SIDE = 9
# How many bytes a pixel has in each colour type of PNG (8 bits a channel), and the start of a PNG file.
_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PNG = b"\x89PNG\r\n\x1a\n"


def image_files(entries: DataFrame, skip_cloud: bool = True) -> DataFrame:
    """The image files of ``entries`` (see :mod:`stratafold.sources.walk`), by their suffix: nothing excluded, nothing in bundles, with
    ``skip_cloud`` nothing that is in the cloud only (column ``flags``), each folded path once."""
    rows = entries.where((F.col("kind") == "file") & ~I.excluded(F.col("path"), F.col("name")) & ~I.companion(F.col("name")))
    rows = rows.where((category(F.col("path")) == "image") & ~F.exists(F.split("dir", "/"), I.is_bundle))
    if skip_cloud and "flags" in rows.columns:
        rows = rows.where(~cloud_only(F.col("flags")))
    first = rows.groupBy(casefold(F.col("path")).alias("__fold")).agg(F.min("path").alias("path"))
    return rows.join(first.select("path"), "path", "left_semi")


def _netpbm(raw: bytes) -> np.ndarray | None:
    """Plain or raw PGM and PPM."""
    kind, head, at = raw[:2], [], 2
    while len(head) < 3:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        head.append(int(raw[at:end]))
        at = end
    width, height, most = head
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        values = np.array(raw[at:].split()[: width * height * channels], dtype=np.float64)
    else:
        values = np.frombuffer(raw, ">u2" if most > 255 else np.uint8, width * height * channels, at + 1).astype(np.float64)
    return values.reshape(height, width, channels) * (255.0 / most)


def _bmp(raw: bytes) -> np.ndarray | None:
    """Uncompressed bitmaps of 24 or 32 bits."""
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if bits not in (24, 32) or packed not in (0, 3):
        return None
    step = (width * bits // 8 + 3) // 4 * 4
    lines = np.frombuffer(raw, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * bits // 8]
    pixels = lines.reshape(abs(height), width, bits // 8)[:, :, 2::-1].astype(np.float64)
    return pixels[::-1] if height > 0 else pixels


def _png(raw: bytes) -> np.ndarray | None:
    """PNG with 8 bits a channel, not interlaced."""
    at, data, palette, head = len(_PNG), [], None, None
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[6] or head[3] not in _PNG_CHANNELS:
        return None
    width, height, step = head[0], head[1], _PNG_CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * step + 1)
    above, out = np.zeros(width * step, np.int64), np.empty((height, width * step), np.int64)
    for y in range(height):
        mode, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if mode == 2:
            line = line + above
        elif mode == 1:
            line = np.cumsum(line.reshape(width, step), axis=0).reshape(-1)
        elif mode in (3, 4):
            left = np.zeros(step, np.int64)
            corner = np.zeros(step, np.int64)
            for x in range(0, width * step, step):
                up = above[x : x + step]
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
                left = line[x : x + step] = (line[x : x + step] + guess) & 255
                corner = up
        above = out[y] = line & 255
    pixels = out.reshape(height, width, step)
    if head[3] == 3:
        return None if palette is None else palette[pixels[:, :, 0]].astype(np.float64)
    return pixels[:, :, : 3 if step > 2 else 1].astype(np.float64)


def grey_grid(raw: bytes | None, side: int = SIDE) -> list[int] | None:
    """``side`` x ``side`` grey values of an image (PNG, BMP, PGM, PPM), each the mean of its area; null for what can't be decoded."""
    if not raw:
        return None
    try:
        pixels = _png(raw) if raw[:8] == _PNG else _bmp(raw) if raw[:2] == b"BM" else _netpbm(raw) if raw[:2] in (b"P2", b"P3", b"P5", b"P6") else None
        if pixels is None or not pixels.size:
            return None
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None
    grey = pixels[:, :, 0] if pixels.shape[2] == 1 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])

    def shares(n: int) -> np.ndarray:
        """How much of each pixel belongs to each cell."""
        edges = np.arange(side + 1) * n / side
        inner = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None)
        return inner / inner.sum(axis=1, keepdims=True)

    return np.floor(shares(grey.shape[0]) @ grey @ shares(grey.shape[1]).T + 1e-6).astype(int).reshape(-1).tolist()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _grids(contents: pa.Array) -> pa.Array:
    return pa.array([grey_grid(c) for c in contents.to_pylist()], pa.list_(pa.int32()))


def with_image_hash(rows: DataFrame, content: str = "content", out: str = "hash") -> DataFrame:
    """``rows`` with the canonical perceptual hash of the encoded image in ``content``: the same for turned and mirrored forms; null for
    what can't be decoded."""
    grids = rows.withColumn("__grid", _grids(F.col(content)))
    return grids.withColumn(out, canonical_hash(F.col("__grid"), SIDE)).drop("__grid")


def similar_images(images: DataFrame, content: DataFrame, radius: int = 10) -> tuple[DataFrame, DataFrame]:
    """(``(group_id, path)`` of look-alike images, one row with ``images_hashed``) for ``images(path)`` and ``content(path, content)``. Images that
    can't be decoded are in no group and not counted; equal and turned images are one group; ``group_id`` is the smallest path."""
    hashed = images.select("path").distinct().join(content.select("path", "content"), "path").select("path", "content")
    hashed = cut(with_image_hash(hashed).where("hash IS NOT NULL").select("path", "hash"))
    names = number_vertices(hashed, "path")
    known = hashed.join(names.withColumnRenamed("name", "path"), "path")
    found = clusters.lookalike_groups(known.select("id", "hash"), radius)
    named = found.join(names.withColumnRenamed("name", "path"), "id").join(names.select(F.col("id").alias("group_id"), F.col("name").alias("first")), "group_id")
    return named.select(F.col("first").alias("group_id"), "path"), hashed.agg(F.count("*").alias("images_hashed"))


def find_similar_images(spark: SparkSession, *roots: str, radius: int = 10, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """:func:`similar_images` of the folders ``roots``."""
    from stratafold.sources.walk import read_content, read_tree, top_roots

    return similar_images(image_files(read_tree(spark, *roots, depth=depth)), read_content(spark, *top_roots(roots)), radius)
