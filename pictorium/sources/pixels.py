"""Cut-outs and sizes of decoded pictures, in NumPy: rows of pixels (height, width, channels) in raw bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = 3
PICTURE = "struct<pixels:binary,width:int,height:int>"


def cut(pixels: np.ndarray, l: int, t: int, r: int, b: int) -> np.ndarray:  # noqa: E741
    """The pixels within the bounds (right and bottom exclusive); black where they lie off the picture."""
    out = np.zeros((max(b - t, 0), max(r - l, 0), pixels.shape[2]), pixels.dtype)
    y0, y1, x0, x1 = max(t, 0), min(b, pixels.shape[0]), max(l, 0), min(r, pixels.shape[1])
    if y0 < y1 and x0 < x1:
        out[y0 - t : y1 - t, x0 - l : x1 - l] = pixels[y0:y1, x0:x1]
    return out


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """By linear interpolation between the middles of pixels."""
    out = pixels.astype(float)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        out = out.take(low, axis) * (1 - share) + out.take(np.minimum(low + 1, n - 1), axis) * share
    return np.rint(out).astype(pixels.dtype)


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Upright, after an orientation code of 1 to 8."""
    turned = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1), 6: lambda p: p.swapaxes(0, 1)[:, ::-1], 7: lambda p: p.swapaxes(0, 1)[::-1, ::-1], 8: lambda p: p.swapaxes(0, 1)[::-1]}
    return turned.get(orientation, lambda p: p)(pixels)


def chips(size: int | None = None) -> Callable[..., Column]:
    """pixels, width, height, l, t, r, b -> the cut-out; at most `size` wide and high, if given. Null bounds give null."""

    @F.pandas_udf(PICTURE)
    def cutter(pixels: pd.Series, width: pd.Series, height: pd.Series, l: pd.Series, t: pd.Series, r: pd.Series, b: pd.Series) -> pd.DataFrame:  # noqa: E741
        rows = []
        for data, w, h, *bounds in zip(pixels, width, height, l, t, r, b, strict=True):
            if data is None or any(pd.isna(x) for x in bounds):
                rows.append((None, None, None))
                continue
            out = cut(np.frombuffer(data, np.uint8).reshape(int(h), int(w), CHANNELS), *map(int, bounds))
            if size and max(out.shape[:2]) > size:
                scale = size / max(out.shape[:2])
                out = resized(out, max(1, int(out.shape[1] * scale)), max(1, int(out.shape[0] * scale)))
            rows.append((out.tobytes(), out.shape[1], out.shape[0]))
        return pd.DataFrame(rows, columns=["pixels", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return cutter
