"""Edit distances, bit-parallel, in Arrow batches.

A row of the table of distances is two numbers of as many bits as the longer
text has characters (Myers 1999, as Hyyrö 2003 has it), so a step takes a few
operations on whole numbers for each character of the shorter text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from callwatch.runtime import ship_package


@lru_cache(maxsize=4)
def _places(text: str) -> dict[str, int]:
    """For each character, a number with the bits of its places."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}


def levenshtein(a: str, b: str) -> int:
    """Insertions, deletions and replacements of single characters that turn a
    into b, at least."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    rest = iter(a)
    if all(c in rest for c in b):  # deletions alone
        return len(a) - len(b)
    places = _places(a)
    full = (1 << len(a)) - 1
    up, down = full, 0
    for c in b:
        x = places.get(c, 0) | down
        same = (((x & up) + up) ^ up | x) & full
        right = down | (up | same) ^ full
        left = up & same
        right = right << 1 | 1
        down = right & same
        up = (left << 1 | (right | same) & full ^ full) & full
    return len(b) + up.bit_count() - down.bit_count()


def distances(a: Column, b: Column) -> Column:
    """(distance, a, b): the edit distance of two texts, which aren't null, and
    their lengths in characters."""
    ship_package(SparkSession.active())

    @F.pandas_udf("struct<distance:int,a:int,b:int>")
    def measured(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(levenshtein(a, b), len(a), len(b)) for a, b in zip(left, right, strict=True)], columns=["distance", "a", "b"], dtype="int32")

    return measured(a, b)
