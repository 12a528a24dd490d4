"""Difference hashes of images: 64 bits, one for each pair of neighbours on a 9 x 8 grey grid."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grid_hash(grid: np.ndarray) -> int:
    """8 rows of 9: bit y * 8 + x is set if a pixel is brighter than its right neighbour. Signed 64 bits."""
    g = np.asarray(grid).reshape(8, 9)
    bits = (g[:, :-1] > g[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0))


def shrink(grey: np.ndarray, width: int = 9, height: int = 8) -> np.ndarray:
    """Bicubic resampling that stretches to the grid; the kernel widens when it shrinks."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(1.0, n / m)
        centre = (np.arange(m) + 0.5) * n / m - 0.5
        w = _cubic((np.arange(n)[None, :] - centre[:, None]) / scale)
        return w / w.sum(1, keepdims=True)

    grey = np.asarray(grey, float)
    return np.clip(np.round(weights(grey.shape[0], height) @ grey @ weights(grey.shape[1], width).T), 0, 255)


def decode_grey(data: bytes) -> np.ndarray | None:
    """Luma of an image; PGM and PPM are read here, other types by PIL if it is installed; None if it cannot be read."""
    try:
        if data[:2] in (b"P5", b"P6"):
            parts, at = [], 2
            while len(parts) < 3:
                while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                    at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
                end = at
                while not data[end : end + 1].isspace():
                    end += 1
                parts.append(int(data[at:end]))
                at = end
            w, h, _ = parts
            channels = 1 if data[:2] == b"P5" else 3
            pixels = np.frombuffer(data, np.uint8, w * h * channels, at + 1).reshape(h, w, channels).astype(float)
            return pixels[:, :, 0] if channels == 1 else pixels @ [0.299, 0.587, 0.114]
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("L"), float)
    except MemoryError:
        raise
    except Exception:  # any other failure to decode is an unreadable image
        return None


def grid_hash_column(grid: Column) -> Column:
    """The hash of an array of 72 grey values, row by row; JVM side."""
    bits = [F.when(F.get(grid, F.lit(y * 9 + x)) > F.get(grid, F.lit(y * 9 + x + 1)), F.lit(1 << (y * 8 + x) if y * 8 + x < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for y in range(8) for x in range(8)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


@F.pandas_udf(T.LongType())
def image_hash(content: pd.Series) -> pd.Series:
    """The hash of an image's bytes; null if it cannot be decoded."""

    def one(data):
        grey = decode_grey(data) if data is not None else None
        return None if grey is None or not grey.size else grid_hash(shrink(grey))

    return content.map(one).astype("Int64")


@F.pandas_udf(T.LongType())
def pixel_hash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """The hash of decoded pixels, row by row: grey, or blue, green and red with or without opacity. Null if there are none."""

    def one(h, w, c, pixels):
        if pixels is None or h is None or min(h, w) <= 0:
            return None
        p = np.frombuffer(pixels, np.uint8).reshape(int(h), int(w), int(c)).astype(float)
        return grid_hash(shrink(p[:, :, 0] if c == 1 else p[:, :, :3] @ [0.114, 0.587, 0.299]))

    return pd.Series([one(*row) for row in zip(height, width, channels, data)], dtype="Int64")
