"""Channel operations on images as arrays of three channels, each an array of pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of red, green and blue.
LUMA = (0.2989, 0.5870, 0.1140)


def luma(image: Column) -> Column:
    """One channel, the weighted sum of three."""
    r, g, b = (F.element_at(image, i) for i in (1, 2, 3))
    rg = F.zip_with(r, g, lambda x, y: x * LUMA[0] + y * LUMA[1])
    return F.zip_with(rg, b, lambda x, y: x + y * LUMA[2])


def one_channel(image: Column, channel: Column) -> Column:
    """All three channels are copies of the one numbered 0, 1 or 2; 3 gives the luma."""
    chosen = F.when(channel == 3, luma(image)).otherwise(F.element_at(image, F.least(channel, F.lit(2)) + 1))
    return F.array(chosen, chosen, chosen)


def erased(image: Column, width: int, top: Column, left: Column, height: Column, breadth: Column, fill: tuple[float, float, float]) -> Column:
    """A rectangle of each channel set to ``fill``; pixels lie row by row, ``width`` a row."""

    def channel(c: int) -> Column:
        def pixel(x: Column, i: Column) -> Column:
            row, col = F.floor(i / width), i % width
            return F.when((row >= top) & (row < top + height) & (col >= left) & (col < left + breadth), F.lit(fill[c])).otherwise(x)

        return F.transform(F.element_at(image, c + 1), pixel)

    return F.array(*[channel(c) for c in range(3)])
