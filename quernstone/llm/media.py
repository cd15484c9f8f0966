"""Media columns: bytes kept in progressive JPEGs, read back scan by scan, with full-resolution RGB tensors.

The unit of the format is the quantised coefficient. Each payload byte b is one coefficient of magnitude 256 + b whose
sign depends on its place only; six 64-byte blocks make a unit of four luma and two chroma blocks (4:2:0). The stream
has a DC scan and its refinement, a low and a high band of luma with a common refinement, and a scan for each chroma
component. The payload's length is in a comment segment. Reading accumulates the scans into coefficient arrays, gets the
payload back from them, and transforms them to RGB with the chroma repeated to full resolution.

Defined results: a null text is empty, which makes a payload of 192 spaces; repeated rows give repeated results; an
empty table gives an empty result; only the id and text columns are read, so other names can't clash. A payload beyond
the format's largest image (65,535 samples a side, 6 GB of text) raises.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import jpeg
from .common import documents

UNIT, BLOCK = 192, 64
SCANS = [
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((1,), 1, 63, 0, 0),
    ((2,), 1, 63, 0, 0),
    ((0,), 1, 63, 1, 0),
    ((0, 1, 2), 0, 0, 1, 0),
]
#: Signs of the coefficients by zigzag position; spreads a block's energy over its pixels. The first (DC) is positive.
SIGNS = np.where((np.arange(64) * (np.arange(64) + 3) // 2 + np.arange(64) // 5) % 2 == 0, 1, -1).astype(np.int32)
#: Limits to the right of the feature grid.
GRID = 8


def payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes with spaces up to a positive multiple of 192, and their own number."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def _frame(units: int) -> tuple[int, int, list[jpeg.Component]]:
    across = math.isqrt(max(units - 1, 0)) + 1
    down = -(-units // across)
    if 16 * max(across, down) > 65535:
        raise ValueError("payload beyond the largest image of the format")
    parts = [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)]
    jpeg.sized(16 * across, 16 * down, parts)
    return across, down, parts


def _orders(parts: list[jpeg.Component], across: int, down: int) -> list[np.ndarray]:
    return [jpeg.unit_order(c, across, down) for c in parts]


def store(data: bytes) -> bytes:
    """A progressive JPEG that holds data (a multiple of 64 bytes) without loss."""
    units = -(-len(data) // (6 * BLOCK))
    across, down, parts = _frame(units)
    filled = np.full((across * down, 6, BLOCK), 32, np.uint8)
    filled.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    coefs = (filled.astype(np.int32) + 256) * SIGNS
    at = 0
    for c, order in zip(parts, _orders(parts, across, down), strict=True):
        c.coefs = np.empty((c.wide * c.high, 64), np.int32)
        c.coefs[order] = coefs[:, at : at + order.shape[1]]
        at += order.shape[1]
    return jpeg.encode(16 * across, 16 * down, parts, {0: np.ones(64, np.int32)}, SCANS, str(len(data)).encode())


def load(media: bytes) -> tuple[bytes, jpeg.Image]:
    """The payload and the image with its accumulated coefficients."""
    image = jpeg.decode(media)
    across, down = image.width // 16, image.height // 16
    units = np.concatenate([c.coefs[o] for c, o in zip(image.components, _orders(image.components, across, down), strict=True)], axis=1)
    data = (units * SIGNS - 256).astype(np.uint8).tobytes()
    return data[: int(image.comment)], image


@lru_cache(1024)
def _limits(size: int) -> np.ndarray:
    """Where the cells of the feature grid begin along one side."""
    return np.linspace(0, size, GRID + 1).astype(int)[:-1]


def feature(rgb: np.ndarray) -> str:
    """Means of the channels in hundredths, and a hash of which cells of a grid are lighter than the mean."""
    n = rgb.shape[0] * rgb.shape[1]
    # rows are added up first, as whole runs of numbers
    bands = np.add.reduceat(rgb.reshape(rgb.shape[0], -1), _limits(rgb.shape[0]), 0, dtype=np.int64).reshape(GRID, -1, 3)
    cells = np.add.reduceat(bands, _limits(rgb.shape[1]), 1)
    sums = bands.sum((0, 1))
    cells = cells.sum(2)
    bits = (cells > np.sort(cells, axis=None)[GRID * GRID // 2 - 1]).ravel()
    return "-".join(str(int(s) * 100 // n) for s in sums) + "-" + np.packbits(bits).tobytes().hex()


def media_column(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: bool = False) -> DataFrame:
    """Stores every whole text as media, reads the stored bytes back and describes them.

    With keep, also the JPEG (media), and the tensor (rgb: bytes in rows of width x 3, with width and height).
    """
    extra = ", media binary, width int, height int, rgb binary" * keep

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media", "width", "height", "rgb"] * keep]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].tolist(), batch["text"], strict=True):
                data, own = payload(text)
                media = store(data)
                back, image = load(media)
                rgb = jpeg.rgb(image)
                kept = (media, image.width, image.height, rgb.tobytes()) if keep else ()
                rows.append((doc, own, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb), *kept))
            yield pd.DataFrame(rows, columns=names)

    kind = df.schema[id_column].dataType.simpleString()
    read = df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text")
    return read.mapInPandas(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{extra}")


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every whole document as a progressive JPEG, read back."""
    return media_column(documents(spark, sf_dir))


QUERIES = {"op2_media_columns": op2_media_columns}
