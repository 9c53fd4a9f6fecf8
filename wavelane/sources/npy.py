"""Arrays of single precision in .npy files of version 1."""

from __future__ import annotations

import numpy as np

from ..errors import InputError, ModelError


def load(path: str) -> np.ndarray:
    """The array in row order; another version or type is refused."""
    try:
        with open(path, "rb") as f:
            try:
                version = np.lib.format.read_magic(f)
                if version != (1, 0):
                    raise ModelError(f"{path}: version {version[0]}.{version[1]} isn't 1.0")
                shape, by_column, kind = np.lib.format.read_array_header_1_0(f)
            except ValueError as e:
                raise ModelError(f"{path}: no .npy file: {e}") from e
            raw = f.read()
    except OSError as e:
        raise InputError(f"{path}: {e}") from e
    if kind != np.dtype("<f4") or by_column:
        raise ModelError(f"{path}: {kind}{' by columns' if by_column else ''} isn't float32 by rows")
    if len(raw) != 4 * int(np.prod(shape)):
        raise ModelError(f"{path}: {len(raw)} bytes aren't {shape} values")
    return np.frombuffer(raw, "<f4").reshape(shape)
