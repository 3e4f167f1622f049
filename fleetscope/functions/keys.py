"""Column rules for resource keys, user names, paths and object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_tail(resource_key: Column) -> Column:
    """Text after the last colon; the whole key when it has none."""
    return F.substring_index(resource_key, ":", -1)


def file_prefixes(resource_key: Column) -> Column:
    """Every colon-terminated prefix that can equal ``repo:file:``.

    A file prefix has two colons at least, so the bare ``repo:`` prefix, which
    all claims of a repository share, is never produced.
    """
    parts = F.split(resource_key, ":")
    return F.when(
        F.size(parts) > 2,
        F.transform(
            F.sequence(F.lit(2), F.size(parts) - 1),
            lambda i: F.concat(F.array_join(F.slice(parts, 1, i), ":"), F.lit(":")),
        ),
    ).otherwise(F.array().cast("array<string>"))


def provider_of(user_name: Column) -> Column:
    """Text before the first underscore; NULL without one."""
    return F.when(F.contains(user_name, F.lit("_")), F.split_part(user_name, F.lit("_"), F.lit(1)))


def subject_of(user_name: Column) -> Column:
    """Text after the first underscore; NULL without one."""
    return F.when(F.contains(user_name, F.lit("_")), F.regexp_extract(user_name, r"(?s)^[^_]*_(.*)$", 1))


def allowlist_key(email: Column) -> Column:
    return F.lower(F.trim(F.coalesce(email, F.lit(""))))


def normalize_resource_key(path: Column) -> Column:
    """``/d/x`` to ``d:/x``, backslashes to slashes, one final slash off, lower case."""
    drive = F.regexp_replace(path, r"^/([a-zA-Z])/(?s)(.*)$", "$1:/$2")
    slashes = F.regexp_replace(drive, r"\\", "/")
    return F.lower(F.regexp_replace(slashes, r"/\z", ""))


def local_identity(device_id: Column, machine_id: Column) -> Column:
    """Device id, else machine id; an empty string counts as absent."""
    return F.coalesce(F.nullif(device_id, F.lit("")), F.nullif(machine_id, F.lit("")))


def is_self(machine_id: Column, local_id: Column) -> Column:
    """True only when the local id is known and equal."""
    return F.nullif(local_id, F.lit("")).isNotNull() & F.coalesce(machine_id == local_id, F.lit(False))


def cold_key(tenant_id: Column, session_id: Column) -> Column:
    return F.concat(F.lit("tenant/"), tenant_id, F.lit("/session/"), session_id, F.lit(".log"))


_COLD_KEY = r"^tenant/([^/]+)/session/([^/]+)\.log$"


def tenant_of_key(key: Column) -> Column:
    """Tenant of a cold object key; NULL outside the key grammar."""
    return F.nullif(F.regexp_extract(key, _COLD_KEY, 1), F.lit(""))


def session_of_key(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, _COLD_KEY, 2), F.lit(""))


def under_prefix(key: Column, prefix: str) -> Column:
    return F.startswith(key, F.lit(prefix))


def email_is_canonical(email: Column) -> Column:
    """False for an address a case-sensitive lookup would miss."""
    return email == F.lower(email)
