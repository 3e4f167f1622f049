"""Words and hashed word shingles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.words import WHITE

SIZE = 5


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; none for null, empty or blank texts."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{WHITE}]+")
    return F.filter(parts, lambda word: word != "")


def shingles(words_col: str, size: int = SIZE) -> Column:
    """Hashes of every run of ``size`` words, in order; empty if there are fewer words."""
    run = ", ".join(f"element_at({words_col}, i + {j})" for j in range(size))
    whole = f"transform(sequence(1, size({words_col}) - {size - 1}), i -> xxhash64({run}))"
    return F.expr(f"CASE WHEN size({words_col}) >= {size} THEN {whole} ELSE array() END").cast("array<bigint>")


def window(hashes: str, start: str, size: str) -> Column:
    """``size`` shingles from place ``start`` (0-based, may be below 0), cut at the text's ends."""
    return F.expr(
        f"CASE WHEN {size} + least({start}, 0) > 0 "
        f"THEN slice({hashes}, cast(greatest({start}, 0) + 1 AS int), cast({size} + least({start}, 0) AS int)) "
        f"ELSE array() END"
    ).cast("array<bigint>")


def shared_weight(left: str, right: str) -> Column:
    """Weight that two shingle lists share: for each distinct shingle the smaller of its two counts."""
    return F.expr(
        f"aggregate(array_distinct({left}), 0, (sum, h) -> sum + least("
        f"size(filter({left}, x -> x = h)), size(filter({right}, x -> x = h))))"
    )


def places(docs: DataFrame, hashes: str) -> DataFrame:
    """``docs`` with a row (place, hash) for each shingle in column ``hashes``.

    The outer form, as the plain one makes Spark infer a filter that hashes all texts again.
    """
    return docs.select("*", F.posexplode_outer(hashes).alias("place", "hash"))
