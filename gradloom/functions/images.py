"""Image kernels for scanned pages, in NumPy, and their use on binary columns.

Images are 2-d arrays of 8-bit grey values. Codecs are a parameter: the default reads and
writes the plain PGM format.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradloom.workers import ship


def read_pgm(data: bytes) -> np.ndarray:
    head, at = [], 0
    while len(head) < 4:
        end = min(x for x in (data.find(b" ", at), data.find(b"\n", at)) if x >= 0)
        head.append(data[at:end])
        at = end + 1
    return np.frombuffer(data, np.uint8, int(head[1]) * int(head[2]), at).reshape(int(head[2]), int(head[1]))


def write_pgm(image: np.ndarray) -> bytes:
    return f"P5\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def grayscale(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    lead = (size - 1) // 2
    padded = np.pad(image, ((lead, size - 1 - lead),) * 2, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size))


def median_blur(image: np.ndarray, size: int = 3) -> np.ndarray:
    return np.median(_windows(image, size), axis=(2, 3)).astype(np.uint8)


def sharpen(image: np.ndarray) -> np.ndarray:
    kernel = np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]])
    return np.clip(np.einsum("ijkl,kl->ij", _windows(image, 3).astype(int), kernel), 0, 255).astype(np.uint8)


def adaptive_threshold(image: np.ndarray, block: int = 11, c: int = 2) -> np.ndarray:
    """White where a pixel is above its Gaussian neighbourhood mean less ``c``."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    x = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    x /= x.sum()
    padded = np.pad(image.astype(float), block // 2, mode="edge")
    rows = np.apply_along_axis(np.convolve, 1, padded, x, "valid")
    mean = np.apply_along_axis(np.convolve, 0, rows, x, "valid")
    return np.where(image > np.rint(mean) - c, 255, 0).astype(np.uint8)


def closing(image: np.ndarray, size: int = 2) -> np.ndarray:
    return _windows(_windows(image, size).max(axis=(2, 3)), size).min(axis=(2, 3))


def opening(image: np.ndarray, size: int = 2) -> np.ndarray:
    return _windows(_windows(image, size).min(axis=(2, 3)), size).max(axis=(2, 3))


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned by ``angle`` degrees about the centre, white where nothing was."""
    h, w = image.shape
    a = np.deg2rad(angle)
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    sx, sy = np.rint(np.cos(a) * x - np.sin(a) * y + (w - 1) / 2).astype(int), np.rint(np.sin(a) * x + np.cos(a) * y + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(image, 255)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def skew(image: np.ndarray, most: float = 45.0, step: float = 0.5) -> float:
    """The angle that makes the rows of dark pixels sharpest."""
    y, x = np.nonzero(image < 128)
    if not len(y):
        return 0.0

    def sharpness(angle: float) -> float:
        a = np.deg2rad(angle)
        rows = np.rint(np.cos(a) * y - np.sin(a) * x).astype(int)
        return float((np.bincount(rows - rows.min()) ** 2).sum())

    angles = np.arange(-most, most + step, step)
    return float(max(angles, key=lambda a: (sharpness(a), -abs(a))))


def preprocess(image: np.ndarray, denoise: bool = True, deskew: bool = True, threshold: bool = True, clean: bool = True) -> np.ndarray:
    out = median_blur(grayscale(image)) if denoise else grayscale(image)
    if deskew and abs(angle := skew(out)) > 0.5:
        out = rotate(out, angle)
    out = adaptive_threshold(out) if threshold else out
    return opening(out) if clean else out


def map_images(rows: DataFrame, column: str, change: Callable[[np.ndarray], np.ndarray], read=read_pgm, write=write_pgm) -> DataFrame:
    """``rows`` with the images of a binary column changed."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if x is None else write(change(read(x))) for x in b.column(at).to_pylist()], pa.binary())
            yield b.set_column(at, b.schema.field(at), new)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)
