"""A Bloom filter of bounded size ahead of a join, so that rows without a partner are not shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Power of two of the bits of the largest filter that is sent to tasks: 32 MB.
MAX_BITS = 28


def might_be(column: str, wanted: DataFrame) -> Column:
    """Whether a value may be among those of ``wanted``, a table with one column of numbers; false for null.

    It is true for every wanted value, and for others by chance, the more the fuller the filter is: the join that follows
    has to decide. The filter is built on the executors and has at most ``2 ** MAX_BITS`` bits at any size.
    """
    bits = 1 << min(MAX_BITS, max(12, (16 * wanted.count()).bit_length()))

    def places(c: str) -> list[Column]:
        # As long: the hash of a number depends on its type.
        return [F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit(i)), F.lit(bits)) for i in range(2)]

    cells = (
        wanted.select(F.explode(F.array(*places(f"`{wanted.columns[0]}`"))).alias("at"))
        .groupBy(F.expr("shiftright(at, 6)").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
        .toArrow()
    )
    filled = np.zeros(bits // 64, np.int64)
    filled[np.asarray(cells["cell"])] = np.asarray(cells["bits"])
    shared = wanted.sparkSession.sparkContext.broadcast(filled)

    def passes(first: pa.Array, second: pa.Array) -> pa.Array:
        table, a, b = shared.value, np.asarray(first), np.asarray(second)
        return pa.array(((table[a >> 6] >> (a & 63)) & (table[b >> 6] >> (b & 63)) & 1).astype(bool))

    return F.col(column).isNotNull() & F.arrow_udf(passes, "boolean")(*places(column))


def maybe_in(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose value may be among those of ``wanted``."""
    return df.where(might_be(column, wanted))
