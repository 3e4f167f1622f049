"""Column rules that judge one infrastructure change.

All of them are narrow expressions over literal lookup maps: classifying a
change needs no join and no shuffle.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv

# JSON texts of the values that do not count as "unknown".
_FALSY_JSON = ("null", "false", "0", '""', "[]", "{}")


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def _pair(resource_type: Column, attribute: Column) -> Column:
    return F.concat(resource_type, F.lit("|"), attribute)


_REASONS = {f"{t}|{a}": why for (t, a), why in fv.NEGATING.items()}
_NEGATING_NAMES = {kind: sorted(a for t, a in fv.NEGATING if t == kind) for kind, _ in fv.NEGATING}
_RANKS = {f"{t}|{a}": rank for rank, (t, a) in enumerate(fv.NEGATING_PRIORITY)}


def _json(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


def _differs(before: Column, after: Column):
    return lambda k: _json(F.try_element_at(before, k)) != _json(F.try_element_at(after, k))


def _not_known(after_unknown: Column):
    return lambda k: ~_json(F.try_element_at(after_unknown, k)).isin(*_FALSY_JSON)


def changed_attributes(before: Column, after: Column, after_unknown: Column) -> Column:
    """Sorted names of top-level attributes that differ or are not yet known.

    Values are ``MAP<STRING, VARIANT>``; a missing key equals a null. Only names
    leave this expression.
    """
    empty = F.array().cast("array<string>")
    names = F.array_union(F.coalesce(F.map_keys(before), empty), F.coalesce(F.map_keys(after), empty))
    differing = F.filter(names, _differs(before, after))
    unknown = F.filter(F.coalesce(F.map_keys(after_unknown), empty), _not_known(after_unknown))
    return F.sort_array(F.array_union(differing, unknown))


def negating_names(resource_type: Column) -> Column:
    """Sorted names of the attributes whose change is a negation for the type."""
    known = chain.from_iterable((F.lit(kind), F.array(*map(F.lit, names))) for kind, names in _NEGATING_NAMES.items())
    return F.coalesce(F.try_element_at(F.create_map(*known), resource_type), F.array().cast("array<string>"))


def changed_negating(resource_type: Column, before: Column, after: Column, after_unknown: Column) -> Column:
    """``negating_hits`` of the ``changed_attributes``, for which the values of no other attribute are read."""
    differs, not_known = _differs(before, after), _not_known(after_unknown)
    return F.filter(negating_names(resource_type), lambda k: differs(k) | not_known(k))


def is_terraform_owned(resource_type: Column, attributes: Column) -> Column:
    """False only when a deploy-owned type changed in nothing but deploy-owned attributes."""
    rest = F.array_except(attributes, F.array(*[F.lit(a) for a in fv.DEPLOY_OWNED_ATTRIBUTES]))
    return ~(resource_type.isin(*fv.DEPLOY_OWNED_TYPES) & (F.size(attributes) > 0) & (F.size(rest) == 0))


def negating_hits(resource_type: Column, attributes: Column) -> Column:
    return F.array_intersect(attributes, negating_names(resource_type))


def first_by_priority(resource_type: Column, hits: Column) -> Column:
    """The hit to report: best rank, then attribute order; NULL without hits."""
    ranks = _literal_map(_RANKS)
    ranked = F.transform(
        hits,
        lambda a: F.struct(
            F.coalesce(F.try_element_at(ranks, _pair(resource_type, a)), F.lit(len(_RANKS))).alias("rank"),
            a.alias("attribute"),
        ),
    )
    return F.array_min(ranked)["attribute"]


def is_clean(actions: Column) -> Column:
    """True for a change that classifies as ``ok``: nothing but no-ops, or a plain read."""
    return (F.size(F.array_remove(actions, "no-op")) == 0) | (actions == F.array(F.lit("read")))


def judged_by_attributes(actions: Column) -> Column:
    """True where ``classify_change`` looks at the attributes: an update that deletes nothing."""
    return F.coalesce(F.array_contains(actions, "update") & ~F.array_contains(actions, "delete"), F.lit(True))


def may_be_deploy_owned(resource_type: Column) -> Column:
    """True where ``is_terraform_owned`` looks at the attributes."""
    return F.coalesce(resource_type.isin(*fv.DEPLOY_OWNED_TYPES), F.lit(True))


def classify_change(resource_type: Column, actions: Column, attributes: Column, hits: Column) -> Column:
    """``STRUCT<classification, attribute, _reason>`` of one change.

    ``hits`` is ``negating_hits`` of the same change, taken as a column so that
    it is computed once.
    """
    none = F.lit(None).cast("string")
    acts = F.array_remove(actions, "no-op")
    serving = resource_type.isin(*fv.SERVING_TYPES)
    sensitive = resource_type.isin(*fv.SENSITIVE_CREATE_TYPES)
    top = first_by_priority(resource_type, hits)
    reason = F.try_element_at(_literal_map(_REASONS), _pair(resource_type, top))
    others = F.concat(F.lit(" [also negating: "), F.array_join(F.array_remove(hits, top), ", "), F.lit("]"))

    def has(verb: str) -> Column:
        return F.array_contains(acts, verb)

    def verdict(classification: str, attribute: Column, *reason_parts: str | Column) -> tuple[Column, ...]:
        parts = [F.lit(part) if isinstance(part, str) else part for part in reason_parts]
        return F.lit(classification), attribute, F.concat(*parts)

    only_create = acts == F.array(F.lit("create"))
    verb = F.when(has("create"), F.lit("replace")).otherwise(F.lit("destroy"))
    live = verdict("active_negation", none, verb, " of a live serving resource (", resource_type, ")")
    grant = verdict("in_place_change", none, "create of a security-sensitive resource (", resource_type, ")")
    negated = verdict("active_negation", top, reason, F.when(F.size(hits) > 1, others).otherwise(F.lit("")))
    updated = verdict("in_place_change", F.try_element_at(attributes, F.lit(1)), "update in place")
    cases = [
        (F.size(acts) == 0, verdict("ok", none, "no change")),
        (actions == F.array(F.lit("read")), verdict("ok", none, "data source refresh")),
        (has("delete") & serving, live),
        (has("delete"), verdict("in_place_change", none, "destroy of ", resource_type)),
        (only_create & sensitive, grant),
        (only_create, verdict("benign_add", none, "create")),
        (has("update") & (F.size(hits) > 0), negated),
        (has("update"), updated),
        (F.lit(True), verdict("unknown", none, "unrecognised actions ", F.to_json(actions))),
    ]
    # a case per field, so that a field nobody reads is not computed
    fields = []
    for at, name in enumerate(("classification", "attribute", "_reason")):
        field = F
        for condition, verdicts in cases:
            field = field.when(condition, verdicts[at])
        fields.append(field.alias(name))
    return F.struct(*fields)


def severity_rank(classification: Column) -> Column:
    return F.try_element_at(_literal_map(fv.SEVERITY), classification)
