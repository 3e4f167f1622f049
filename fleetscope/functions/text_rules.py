"""Column rules for work-item status documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv

_WORDS = "|".join(fv.LIFECYCLE_WORDS)


def status_block(text: Column) -> Column:
    """The first quoted block whose first line holds ``**Status:``; NULL if none.

    Two plain scans instead of one pattern with a repeated group: a repeated
    group recurses per line in the JVM and would overflow on a long block.
    """
    lines = F.regexp_replace(text, r"\R|[\x1c-\x1e]", "\n")
    from_block = F.regexp_extract(lines, r"(?ms)^>[^\n]*\*\*Status:.*", 0)
    block = F.regexp_replace(from_block, r"(?s)\n(?!>).*", "")
    return F.nullif(F.regexp_replace(block, r"(?m)^> ?", ""), F.lit(""))


def lifecycle(block: Column) -> Column:
    """Leftmost lifecycle word of a status block; NULL if none."""
    return F.nullif(F.regexp_extract(block, rf"\b({_WORDS})\b", 1), F.lit(""))


def summary(block: Column) -> Column:
    """Text after the lifecycle word up to the first blank line, tidied."""
    after = F.regexp_extract(block, rf"(?s)\b(?:{_WORDS})\b(.*)", 1)
    paragraph = F.regexp_replace(after, r"(?s)\n\s*\n.*", "")
    flat = F.trim(F.regexp_replace(paragraph, r"(?U)\s+", " "))
    undated = F.regexp_replace(flat, r"^\d{4}-\d{2}-\d{2}\.?\s*", "")
    unbold = F.regexp_replace(undated, r"^\*+\s*", "")
    return F.nullif(F.trim(F.regexp_replace(unbold, r"^[.:\- ]+", "")), F.lit(""))


def depends_on(block: Column) -> Column:
    """Stems named after a dependency marker on the same line, first seen first."""
    marked = F.filter(F.split(block, "\n"), lambda line: F.contains(line, F.lit(fv.DEPENDS_MARKER)))
    stems = F.transform(
        marked,
        lambda line: F.regexp_extract_all(
            F.regexp_extract(line, f"{fv.DEPENDS_MARKER}(.*)", 1), F.lit(fv.STEM_PATTERN), F.lit(0)
        ),
    )
    return F.coalesce(F.array_distinct(F.flatten(stems)), F.array().cast("array<string>"))


def status_word(block: Column, no_word: str = fv.NO_BLOCK) -> Column:
    """Lifecycle word, with DRAFT for no block and ``no_word`` for a wordless block.

    The resolver reads a wordless block as DRAFT, the graph as ``?``.
    """
    return F.when(block.isNull(), F.lit(fv.NO_BLOCK)).otherwise(F.coalesce(lifecycle(block), F.lit(no_word)))


def unsatisfied_reason(status: Column) -> Column:
    """Why a dependency with this status blocks its consumer; NULL if it does not."""
    return (
        F.when(status == "SHIPPED", F.lit(None).cast("string"))
        .when(status == fv.MISSING, F.lit("missing_file"))
        .when(status.isin(*fv.TERMINAL_WORDS), F.lit("terminal_blocker"))
        .otherwise(F.lit("not_yet_shipped"))
    )


def term_match(message: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """True when every term occurs literally, case-sensitive, in the message."""
    found = F.lit(True)
    for term in terms:
        found = found & F.contains(message, F.lit(term))
    return F.coalesce(found, F.lit(False))
