"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The white space that separates words, U+0009 to U+000D and U+0020.
# bytes.split() and bytes.strip() use the same six characters.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def fresh(name: str, df: DataFrame) -> str:
    """A column name that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(array: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string array, without decoding them."""
    return array.cast(pa.binary()).to_pylist()


def in_slices(sizes: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``most`` in all, at least one row each."""
    start = total = at = 0
    for at, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, at
            start, total = at, 0
    if start < at:
        yield start, at


def running_sums(values: Column, block: int = 64) -> Column:
    """Exclusive running sums of an array of numbers, in linear time.

    Sums of blocks first, then sums inside each block, so no growing array is
    copied at every element.  An empty array gives an empty array.
    """
    n = F.size(values)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(blocks, lambda k: total(F.slice(values, k * block + 1, F.lit(block))))

    def placed(whole: Column) -> Column:
        # whole: one struct with the values and the sums of their blocks
        before = F.transform(blocks, lambda k: total(F.slice(whole["s"], F.lit(1), k)))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("k"), before.alias("b")), lambda z: F.transform(
            F.sequence(F.lit(0), F.least(F.lit(block), n - z["k"] * block) - 1),
            lambda i: z["b"] + total(F.slice(whole["v"], z["k"] * block + 1, i)))))

    return F.element_at(F.transform(F.array(F.struct(values.alias("v"), sums.alias("s"))), placed), 1)


def codes_of(values: np.ndarray) -> np.ndarray:
    """Dense numbers of equal values."""
    return np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64)
