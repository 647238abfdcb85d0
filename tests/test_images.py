"""Decoding, hashes and groups of images."""

import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from stratafold.sources.images import find_similar_images, grey_grid, image_files, with_image_hash
from stratafold.sources.walk import read_tree


def png(grey, modes=(0,), colour=0):
    h, w = grey.shape
    lines, above = [], np.zeros(w, int)
    for y in range(h):
        line, mode = grey[y].astype(int), modes[y % len(modes)]
        left, corner = np.r_[0, line[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][mode]
        lines.append(bytes([mode]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def pgm(grey):
    return f"P5\n# x\n{grey.shape[1]} {grey.shape[0]}\n255\n".encode() + grey.astype(np.uint8).tobytes()


def bmp(grey):
    h, w = grey.shape
    step = (w * 3 + 3) // 4 * 4
    body = b"".join(np.repeat(grey[y], 3).astype(np.uint8).tobytes().ljust(step, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(body), 0, 54, 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def picture(seed, n=27):
    r = np.random.default_rng(seed)
    return np.kron(r.integers(0, 256, (9, 9)), np.ones((n // 9, n // 9), int))


def test_formats_agree():
    p = picture(1)
    plain = grey_grid(pgm(p))
    assert plain == p[::3, ::3].reshape(-1).tolist()
    assert grey_grid(png(p, (0, 1, 2, 3, 4))) == grey_grid(bmp(p)) == plain
    text = "P2 27 27 255 " + " ".join(map(str, p.reshape(-1)))
    assert grey_grid(text.encode()) == plain
    for bad in (None, b"", b"no image", png(p)[:60], b"P5 9", png(p, colour=9)):
        assert grey_grid(bad) is None


def test_groups_of_a_folder(spark, tmp_path):
    a, b = picture(2), picture(3)
    noisy = np.clip(a + np.random.default_rng(1).integers(-2, 3, a.shape), 0, 255)
    (tmp_path / "x.app").mkdir()
    for name, raw in {
        "a.png": png(a), "turned.bmp": bmp(np.rot90(a)), "mirror.png": png(a[:, ::-1], (4,)), "noisy.png": png(noisy), "b.png": png(b), "broken.png": b"\x89PNG", "note.txt": pgm(a), "x.app/in.png": png(a), "B.PNG": png(b),
    }.items():
        (tmp_path / name).write_bytes(raw)
    groups, counts = find_similar_images(spark, str(tmp_path))
    got = {}
    for r in groups.collect():
        got.setdefault(r["group_id"].rsplit("/", 1)[1], set()).add(r["path"].rsplit("/", 1)[1])
    assert got == {"a.png": {"a.png", "turned.bmp", "mirror.png", "noisy.png"}}
    # B.PNG and b.png are one path to a view that folds case
    assert counts.collect()[0]["images_hashed"] == 5
    rows = read_tree(spark, str(tmp_path)).withColumn("flags", F.when(F.col("name") == "a.png", 0x40000000).otherwise(0))
    assert "a.png" not in {r["name"] for r in image_files(rows).collect()} and image_files(rows, skip_cloud=False).count() == 6


def test_hashes_of_columns(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(pgm(picture(r.randrange(99))),), (None,), (b"x",)], "c binary")
    assert [x["hash"] is None for x in with_image_hash(df, "c").collect()] == [False, True, True]
