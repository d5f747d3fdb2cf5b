"""A bitmap of hashes of fixed size, to sort out rows before a shuffle where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.llm._scratch import free

#: A sieve has at most 2 ** SIEVE rows of 64 bits.
SIEVE = 18


def sieve(df: DataFrame, key: Column) -> DataFrame:
    """(word, bits): the 64-bit hashes that df has, in a bitmap whose size does not depend on their number."""
    hashed = df.select(key.alias("h"))
    return hashed.groupBy(F.shiftrightunsigned("h", 64 - SIEVE).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))


def marked(df: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """df and whether the sieve has the hash of each row: true for all that the sieve was made of, and for some others."""
    word, held, h = free(df, "__vc_word", "__vc_bits", "__vc_hash")
    known = F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(held)))
    hashed = df.withColumn(h, key)
    found = hashed.join(known, F.shiftrightunsigned(h, 64 - SIEVE) == F.col(word), "left")
    hit = F.expr(f"getbit({held}, cast({h} & 63 as int)) = 1")
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop(word, held, h)


def sifted(df: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """The rows of which the sieve has the hash."""
    [name] = free(df, "__vc_in")
    return marked(df, key, bits, name).where(name).drop(name)
