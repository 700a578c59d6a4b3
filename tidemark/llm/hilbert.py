"""Hilbert keys of whole batches of points."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of `cells` (n x dims, integers below 2**bits).

    The bit-plane transform of Skilling (2004): undo the excess rotations from the top plane down,
    Gray-encode, then interleave the planes. dims * bits may be 63 at most.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("a key has 63 bits at most")
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(dims):
            high = (x[i] & plane) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        plane >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where((x[dims - 1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key
