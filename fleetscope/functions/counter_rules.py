"""Column rules for cache counter documents (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole_number(value: Column) -> Column:
    """Integer part of a JSON number or boolean; NULL for any other JSON type."""
    kind = F.schema_of_variant(value)
    broken = kind.isin("DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    # whole numbers are read as such, as a double holds 53 bits only
    return F.when(kind.isin("BIGINT", "BOOLEAN"), F.try_variant_get(value, "$", "bigint")).when(
        broken, F.try_variant_get(value, "$", "double").cast("bigint")
    )


def flat_counters(doc: Column) -> Column:
    """The ``stats`` object if present, else the document itself."""
    return F.coalesce(F.try_variant_get(doc, "$.stats", "variant"), doc)


def scalar_counter(flat: Column, name: str) -> Column:
    return _whole_number(F.try_variant_get(flat, f"$.{name}", "variant"))


def counter_total(flat: Column, name: str) -> Column:
    """Sum of the numeric entries of ``<name>.counts``, 0 without counts; NULL when ``<name>`` or its counts are no object."""
    kind = F.schema_of_variant(F.try_variant_get(flat, f"$.{name}", "variant"))
    of_counts = F.schema_of_variant(F.try_variant_get(flat, f"$.{name}.counts", "variant"))
    counts = F.try_variant_get(flat, f"$.{name}.counts", "map<string,variant>")
    total = F.aggregate(
        F.coalesce(F.map_values(counts), F.array().cast("array<variant>")),
        F.lit(0).cast("bigint"),
        lambda acc, v: acc + F.coalesce(_whole_number(v), F.lit(0).cast("bigint")),
    )
    readable = F.coalesce(F.startswith(of_counts, F.lit("OBJECT")) | of_counts.isin("VOID"), F.lit(True))
    return F.when(F.startswith(kind, F.lit("OBJECT")) & readable, total)
