"""Sinks that end in bytes: PNG, the packed depth raster, multipart bodies."""

from __future__ import annotations

import gzip
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BOUNDARY = "panorama-parts"


def png(array: np.ndarray) -> bytes:
    """A PNG of (h, w) 16-bit, (h, w, 3) or (h, w, 4) 8-bit samples."""
    kind, depth = {2: (0, 16), 3: (2, 8)}[array.ndim] if array.ndim == 2 or array.shape[2] == 3 else (6, 8)
    raw = array.astype(">u2" if depth == 16 else np.uint8)
    lines = b"".join(b"\0" + line.tobytes() for line in raw)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", array.shape[1], array.shape[0], depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def images(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(view, png) from pixels (view, col, row, r, g, b[, a]); a view's image is bounded by the pixel limit of requests."""
    bands = ["r", "g", "b", *(["a"] if "a" in pixels.columns else [])]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width, len(bands)), np.uint8)
        out[rows["row"], rows["col"]] = rows[bands].to_numpy()
        return pd.DataFrame({"view": [key[0]], "png": [png(out)]})

    return pixels.groupBy("view").applyInPandas(one, "view bigint, png binary")


def depth_images(depth: DataFrame, width: int, height: int) -> DataFrame:
    """(view, png): quantised depth codes (view, col, row, q) as a 16-bit grey image."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width), np.uint16)
        out[rows["row"], rows["col"]] = rows["q"].to_numpy()
        return pd.DataFrame({"view": [key[0]], "png": [png(out)]})

    return depth.groupBy("view").applyInPandas(one, "view bigint, png binary")


def packed_depth(deltas: DataFrame, width: int, height: int) -> DataFrame:
    """(view, bytes): row differences as little-endian 16-bit integers, gzipped.  ``deltas``: view, col, row, delta."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width), "<i2")
        out[rows["row"], rows["col"]] = rows["delta"].to_numpy()
        return pd.DataFrame({"view": [key[0]], "bytes": [gzip.compress(out.tobytes(), mtime=0)]})

    return deltas.groupBy("view").applyInPandas(one, "view bigint, bytes binary")


def unpacked_depth(data: bytes, width: int, height: int) -> np.ndarray:
    """The quantised codes of a packed raster."""
    return (np.cumsum(np.frombuffer(gzip.decompress(data), "<i2").reshape(height, width).astype(np.int64), axis=1) & 65535).astype(np.uint16)


def multipart(parts: list[tuple[str, str | None, str, bytes]], waiting: int) -> tuple[dict[str, str], bytes]:
    """Headers and body of a form-data answer from (name, filename, content type, bytes)."""
    body = bytearray()
    for name, filename, kind, data in parts:
        where = f'; filename="{filename}"' if filename else ""
        body += f'--{BOUNDARY}\r\nContent-Disposition: form-data; name="{name}"{where}\r\nContent-Type: {kind}\r\n\r\n'.encode() + data + b"\r\n"
    body += f"--{BOUNDARY}--\r\n".encode()
    return {"content-type": f"multipart/form-data; boundary={BOUNDARY}", "x-queue-depth": str(waiting)}, bytes(body)


def peaks_json(rows: list[dict]) -> str:
    """Selected peaks as an indented document; the sub-column stays inside."""
    return json.dumps([{k: v for k, v in r.items() if k != "column"} for r in rows], indent=2, ensure_ascii=False)
