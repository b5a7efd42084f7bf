"""The zig-zag order and the quantizers of the 8 x 8 cosine transform."""

from __future__ import annotations

import math

#: Annex K of the JPEG standard, in natural order.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]


def zigzag() -> list[int]:
    """Natural index of each zig-zag place: diagonals in turn, alternately up and down."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return [y * 8 + x for y, x in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))]


ZIGZAG = zigzag()


def cosine(u: int, x: int) -> float:
    """Entry of the orthonormal DCT-II matrix."""
    return (math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16)
