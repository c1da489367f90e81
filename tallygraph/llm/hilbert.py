"""Hilbert curve positions of points on a grid, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions (uint64) of integer points ``grid`` (rows x dims, each below
    2**bits) along the Hilbert curve.  ``dims * bits`` must not exceed 63.

    Axes are turned into the transposed index by undoing, from the highest bit
    down, the exchanges and inversions that each subcube applies, and then by
    Gray encoding (Skilling, "Programming the Hilbert curve", 2004).
    """
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("dims * bits must not exceed 63")
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> b) & 1).astype(np.uint64)
    return key
