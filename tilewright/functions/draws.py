"""Seeded draws that do not depend on how rows are spread over partitions.

Every random choice is read off ``md5(seed:key...)``, so a lost executor or another partition
count replays the same values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0
#: Steps between counters and streams, and the multiplier of the mix: odd numbers without structure.
COUNTER_STEP, STREAM_STEP, MIX = 2246822507, 2654435769, 73244475


def draw_key(seed: int | str, *parts: Column | str | int) -> Column:
    """Hex digest of the seed and the parts, joined with ``:``."""
    columns = [F.lit(str(seed))]
    for part in parts:
        columns.append((part if isinstance(part, Column) else F.lit(str(part))).cast("string"))
    return F.md5(F.concat_ws(":", *columns))


def draw_integer(key: Column, word: int = 0) -> Column:
    """One of the four 32-bit words of a digest, as BIGINT."""
    return F.conv(F.substring(key, 1 + 8 * word, 8), 16, 10).cast("bigint")


def draw_uniform(key: Column, word: int = 0) -> Column:
    """A double in [0, 1)."""
    return draw_integer(key, word).cast("double") / F.lit(TWO_POW_32)


def counter_uniforms(seed: int, stream: int, shape: tuple[int, ...]) -> np.ndarray:
    """Doubles in (0, 1), each made from the seed, a stream number and its own place in the array.

    A draw depends on nothing else, so SQL can replay any of them: a counter is mixed three times
    in 32 bits.
    """
    low = np.uint64(0xFFFFFFFF)
    start = np.uint64((seed ^ stream * STREAM_STEP) & 0xFFFFFFFF)
    x = (start + np.arange(int(np.prod(shape)), dtype=np.uint64) * np.uint64(COUNTER_STEP)) & low
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX)) & low
    x ^= x >> np.uint64(16)
    return ((x.astype(np.float64) + 0.5) / TWO_POW_32).reshape(shape)


def counter_normals(seed: int, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normal numbers out of two streams of uniform ones (Box and Muller)."""
    radius = np.sqrt(-2.0 * np.log(counter_uniforms(seed, 0, shape)))
    return radius * np.cos(2.0 * np.pi * counter_uniforms(seed, 1, shape))
