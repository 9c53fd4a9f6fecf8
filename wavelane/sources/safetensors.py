"""Tensors of a safetensors file, read and written by its public layout."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import ModelError

KINDS = {"F32": "<f4", "F64": "<f8", "F16": "<f2", "I64": "<i8", "I32": "<i4"}


def load(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < 8 or (n := struct.unpack("<Q", raw[:8])[0]) > len(raw) - 8:
        raise ModelError(f"{path}: no safetensors file")
    head, base, out = json.loads(raw[8 : 8 + n]), 8 + n, {}
    for name, t in head.items():
        if name == "__metadata__":
            continue
        if t["dtype"] not in KINDS:
            raise ModelError(f"{name}: type {t['dtype']} isn't supported")
        a, b = t["data_offsets"]
        x = np.frombuffer(raw[base + a : base + b], KINDS[t["dtype"]])
        if x.size != int(np.prod(t["shape"])):
            raise ModelError(f"{name}: the data isn't of shape {t['shape']}")
        out[name] = x.reshape(t["shape"])
    return out


def save(path: str, tensors: dict[str, np.ndarray]) -> None:
    head, body = {}, b""
    for name, x in tensors.items():
        data = np.ascontiguousarray(x, "<f4").tobytes()
        head[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + body)


def table(spark: SparkSession, path: str) -> DataFrame:
    """(key, shape, data); a weight file is as small as its model."""
    rows = [(k, list(x.shape), x.astype(np.float32).ravel().tolist()) for k, x in load(path).items()]
    return spark.createDataFrame(rows, "key string, shape array<int>, data array<float>")
