"""OCR payloads and page images.

OCR: `ocr_text` and `ocr_layout` walk JSON of any nesting in Arrow batches; `ocr_layout_of_lines`
is the JVM-side way for the usual shape, a list of words with eight coordinates. Images: a grey
96 x 96 grid becomes 17 numbers. `decode_image` reads PNG and binary PGM and PPM itself, and other kinds
where Pillow is installed; another decoder may be given.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .text import let
from .vectors import zeros

LAYOUT_SIZE, VISUAL_SIZE, GRID = 14, 17, 96
TEXT_KEYS = ("Word", "text", "content")
CORNERS = tuple(f"{axis}{k}" for axis in "XY" for k in range(1, 5))
LINES = "struct<lines_data:array<struct<" + ",".join(["Word:string", "Confidence:double", "page:int", *(f"{c}:double" for c in CORNERS)]) + ">>>"


def text_in(payload: str | None) -> str:
    """All strings under a text key, objects before their parts, joined by blanks. What isn't JSON is text itself."""
    if not payload:
        return ""
    try:
        rest = [json.loads(payload)]
    except (ValueError, RecursionError):
        return payload
    found = []
    while rest:  # a stack instead of recursion: depth is no limit
        node = rest.pop()
        if isinstance(node, dict):
            found += [node[k] for k in TEXT_KEYS if isinstance(node.get(k), str)]
            rest += reversed(list(node.values()))
        elif isinstance(node, list):
            rest += reversed(node)
    return " ".join(found)


def boxes_in(payload: str | None) -> np.ndarray:
    """x, y, width and height of each object with all eight coordinates."""
    try:
        rest, found = [json.loads(payload)] if payload else [], []
    except (ValueError, RecursionError):
        return np.zeros((0, 4))
    while rest:
        node = rest.pop()
        if isinstance(node, dict):
            if all(c in node for c in CORNERS):
                v = {c: float(node[c]) for c in CORNERS}
                found.append(((v["X1"] + v["X3"]) / 2, (v["Y1"] + v["Y3"]) / 2, abs(v["X3"] - v["X1"]), abs(v["Y3"] - v["Y1"])))
            rest += reversed(list(node.values()))
        elif isinstance(node, list):
            rest += reversed(node)
    return np.array(found).reshape(-1, 4)


def layout_of(boxes: np.ndarray) -> list[float]:
    """Fourteen numbers about where a page's words are; zeros without words."""
    if not len(boxes):
        return [0.0] * LAYOUT_SIZE
    x, y, w, h = boxes.T
    shares = [y < 0.20, y > 0.80, x < 0.30, x > 0.70, (x < 0.40) & (y < 0.20), (y >= 0.30) & (y <= 0.70)]
    tail = [y.mean(), y.std(), x.mean(), y.min(), y.max(), min(1.0, float((h * w).sum())), h.mean()]
    return [float(np.log1p(len(x))), *(float(s.mean()) for s in shares), *map(float, tail)]


@F.pandas_udf(StringType())
def ocr_text(payloads: pd.Series) -> pd.Series:
    return payloads.map(text_in, na_action=None)


@F.pandas_udf(ArrayType(DoubleType()))
def ocr_layout(payloads: pd.Series) -> pd.Series:
    return pd.Series([layout_of(boxes_in(p)) for p in payloads])


def layout_aggregates(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """layout_of as aggregates over rows of words."""
    share = lambda p: F.avg(F.when(p, 1.0).otherwise(0.0))
    return [
        F.log1p(F.count("*").cast("double")),
        share(y < 0.20),
        share(y > 0.80),
        share(x < 0.30),
        share(x > 0.70),
        share((x < 0.40) & (y < 0.20)),
        share((y >= 0.30) & (y <= 0.70)),
        F.avg(y),
        F.stddev_pop(y),
        F.avg(x),
        F.min(y),
        F.max(y),
        F.least(F.lit(1.0), F.sum(h * w)),
        F.avg(h),
    ]


def ocr_layout_of_lines(payload: Column) -> Column:
    """ocr_layout for payloads {"lines_data": [{"X1": .., ..}, ..]}, in the JVM."""
    words = F.coalesce(F.from_json(payload, LINES)["lines_data"], F.array().cast(LINES[LINES.index("array") : -1]))
    words = F.filter(words, lambda v: F.forall(F.array(*(v[c] for c in CORNERS)), lambda c: c.isNotNull()))
    box = F.transform(words, lambda v: F.struct(((v["X1"] + v["X3"]) / 2).alias("x"), ((v["Y1"] + v["Y3"]) / 2).alias("y"), F.abs(v["X3"] - v["X1"]).alias("w"), F.abs(v["Y3"] - v["Y1"]).alias("h")))
    return let(box, _box_layout)


def _box_layout(box: Column) -> Column:
    n = F.size(box).cast("double")
    total = lambda f: F.aggregate(box, F.lit(0.0), lambda s, b: s + f(b))
    share = lambda p: total(lambda b: F.when(p(b), 1.0).otherwise(0.0)) / n
    deviation = let(total(lambda b: b["y"]) / n, lambda mean: F.sqrt(total(lambda b: (b["y"] - mean) * (b["y"] - mean)) / n))
    values = [
        F.log1p(n),
        share(lambda b: b["y"] < 0.20),
        share(lambda b: b["y"] > 0.80),
        share(lambda b: b["x"] < 0.30),
        share(lambda b: b["x"] > 0.70),
        share(lambda b: (b["x"] < 0.40) & (b["y"] < 0.20)),
        share(lambda b: (b["y"] >= 0.30) & (b["y"] <= 0.70)),
        total(lambda b: b["y"]) / n,
        deviation,
        total(lambda b: b["x"]) / n,
        F.array_min(F.transform(box, lambda b: b["y"])),
        F.array_max(F.transform(box, lambda b: b["y"])),
        F.least(F.lit(1.0), total(lambda b: b["h"] * b["w"])),
        total(lambda b: b["h"]) / n,
    ]
    return F.when(n > 0, F.array(*values)).otherwise(zeros(LAYOUT_SIZE))


def visual_of(grid: np.ndarray, width: int, height: int) -> list[float]:
    """Seventeen numbers about a grey image of GRID x GRID values from 0 to 1, of width x height before."""
    across, down = np.abs(np.diff(grid, axis=1)).mean(), np.abs(np.diff(grid, axis=0)).mean()
    half, cell = GRID // 2, GRID // 3
    halves = [grid[:half], grid[half:], grid[:, :half], grid[:, half:]]
    cells = [grid[i : i + cell, j : j + cell] for i in range(0, GRID, cell) for j in range(0, GRID, cell)]
    return [float(v) for v in (width / max(1, height), grid.mean(), grid.std(), (across + down) / 2, *(p.mean() for p in halves + cells))]


def image_features(decode: Callable[[bytes], tuple[np.ndarray, int, int]] | None = None):
    """A UDF from image bytes to visual_of. decode gives the grid, width and height, decode_image's by default; no bytes or any error of it give zeros."""

    decode = decode or decode_image

    @F.pandas_udf(ArrayType(DoubleType()))
    def visual(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for raw in batch:
                try:
                    out.append(visual_of(*decode(raw)) if raw else [0.0] * VISUAL_SIZE)
                except Exception:  # noqa: BLE001 - a page without a readable image has no visual features
                    out.append([0.0] * VISUAL_SIZE)
            yield pd.Series(out)

    return visual


def _resampled(pixels: np.ndarray) -> np.ndarray:
    """The grid of a grey image, by area means."""
    for axis in (0, 1):
        size = pixels.shape[axis]
        edges = np.linspace(0, size, GRID + 1)
        sums = np.concatenate([np.zeros_like(pixels.take([0], axis)), pixels.cumsum(axis)], axis)
        low = np.minimum(edges.astype(int), size - 1)
        part = (edges - low).reshape([-1, 1] if axis == 0 else [1, -1])
        at = sums.take(low, axis) + part * pixels.take(low, axis)
        pixels = np.diff(at, axis=axis) / (size / GRID)
    return pixels


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of the channels, without the one for transparency."""
    return pixels[..., 0] if pixels.shape[-1] < 3 else pixels[..., :3] @ np.array([0.299, 0.587, 0.114])


def _pnm(raw: bytes) -> np.ndarray:
    head = raw.split(maxsplit=4)
    width, height, top = (int(v) for v in head[1:4])
    n = 3 if head[0] == b"P6" else 1
    if top > 255:
        raise ValueError("more than 8 bits a sample")
    return np.frombuffer(raw[len(raw) - width * height * n :], np.uint8).reshape(height, width, n) / top


def _png(raw: bytes) -> np.ndarray:
    at, data, palette = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
    if interlaced or depth == 16:
        raise ValueError("interlaced and 16-bit PNG aren't supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step, line = max(1, channels * depth // 8), -(-width * channels * depth // 8)
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        kind, now = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            now += above
        elif kind:
            left = above.astype(int).tolist()
            x = now.tolist()
            for i in range(line):
                a, b, c = (x[i - step], left[i], left[i - step]) if i >= step else (0, left[i], 0)
                if kind == 1:
                    x[i] = x[i] + a & 255
                elif kind == 3:
                    x[i] = x[i] + (a + b) // 2 & 255
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    x[i] = x[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c) & 255
            now = np.array(x, np.uint8)
        out[y] = above = now
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        out = (bits @ (1 << np.arange(depth)[::-1]))[:, : width * channels]
    pixels = out.reshape(height, width, channels)
    return palette[pixels[..., 0]] / 255 if color == 3 else pixels / ((1 << depth) - 1)


def decode_image(raw: bytes) -> tuple[np.ndarray, int, int]:
    """The grid, width and height of an image."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        pixels = _grey(_png(raw))
    elif raw[:2] in (b"P5", b"P6"):
        pixels = _grey(_pnm(raw))
    else:
        import io

        from PIL import Image  # not part of the package's needs; without it other kinds of image have no features

        pixels = np.asarray(Image.open(io.BytesIO(raw)).convert("L"), float) / 255
    height, width = pixels.shape
    return _resampled(pixels), width, height
