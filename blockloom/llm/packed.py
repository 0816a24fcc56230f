"""Arrays of integers as compressed blobs, so that few rows carry many numbers through a shuffle."""

from __future__ import annotations

import numpy as np


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as one blob: byte planes, compressed; Blob reads it."""
    import zstandard

    parts = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        parts += [np.array([len(a), width], "<u4").tobytes(), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


class Blob:
    """Reads the arrays of packed one at a time."""

    def __init__(self, blob: bytes):
        import zstandard

        self.raw = zstandard.ZstdDecompressor().decompress(blob)
        self.at, at = [], 4
        for _ in range(int(np.frombuffer(self.raw, "<u4", 1)[0])):
            n, width = (int(v) for v in np.frombuffer(self.raw, "<u4", 2, at))
            self.at.append((at + 8, n, width))
            at += 8 + n * width

    def __getitem__(self, i: int) -> np.ndarray:
        at, n, width = self.at[i]
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(self.raw, np.uint8, n * width, at).reshape(width, n).T
        return planes.view("<u8").reshape(-1)
