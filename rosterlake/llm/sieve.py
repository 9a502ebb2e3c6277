"""Rows whose key may be in a table of keys, told by two bits a key before anything is shuffled.

The bit table has 16 bits for each key, 2**28 (32 MB) at most: with more keys it
lets more rows through, in the end all, and what follows is a plain join. No row
whose key is in the table is ever held back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 28


def table_of(keys: DataFrame) -> Broadcast:
    """keys: one column of 64-bit hashes, written already, for it is read twice."""
    (name,) = keys.columns
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * keys.count()).bit_length()))
    places = F.explode(F.array(F.shiftrightunsigned(F.col(name), 64 - bits), F.shiftrightunsigned(F.shiftleft(F.col(name), 32), 64 - bits)))
    set_bits = keys.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("held")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[set_bits.column("word").to_numpy()] = set_bits.column("held").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast((bits, table))


def maybe(key: pa.Array, bits: int, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    for skip in (0, 32):
        at = (np.asarray(key).view(np.uint64) << np.uint64(skip)) >> np.uint64(64 - bits)
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def sifted(df: DataFrame, key: str, *tables: Broadcast, inside: bool = True) -> DataFrame:
    """The rows whose key (not null) may be in each of the tables, in one Python step; or, not inside, the others."""

    def run(batches):
        for batch in batches:
            on = np.ones(len(batch), bool)
            for table in tables:
                on &= maybe(batch.column(key), *table.value)
            yield batch.filter(pa.array(on if inside else ~on))

    return df.mapInArrow(run, df.schema)
