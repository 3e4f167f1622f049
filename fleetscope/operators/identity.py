"""Which federated sign-ups may link to exactly one native account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.functions import keys
from fleetscope.session import broadcast_if_small


def unique_native_match(directory: DataFrame) -> DataFrame:
    """E-mails with exactly one confirmed, native, verified account.

    ``directory``: Username, UserStatus, attributes MAP<STRING,STRING>. All
    accounts of an e-mail are looked at, and each contributes a count, not a row.
    """
    attr = F.col("attributes")
    native = directory.where(
        (F.col("UserStatus") == "CONFIRMED")
        & (F.coalesce(attr["identities"], F.lit("")) == "")
        & (attr["email_verified"] == "true")
    )
    return (
        native.groupBy(attr["email"].alias("email"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("Username").alias("destination_user"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def allowlist_gate(signups: DataFrame, allowlist: DataFrame | None) -> DataFrame:
    """Adds ``blocked``. No list, or a list of blanks, blocks nobody."""
    listed = None
    if allowlist is not None:
        listed = allowlist.select(keys.allowlist_key(F.col("email")).alias("_key")).where("_key <> ''").distinct()
    if listed is None or listed.isEmpty():
        return signups.withColumn("blocked", F.lit(False))
    listed = broadcast_if_small(listed.withColumn("_listed", F.lit(True)))
    return (
        signups.withColumn("_key", keys.allowlist_key(F.col("email")))
        .join(listed, "_key", "left")
        .withColumn("blocked", (F.col("trigger_source") != fv.ADMIN_TRIGGER) & F.col("_listed").isNull())
        .drop("_key", "_listed")
    )


def signup_decisions(signups: DataFrame, directory: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """One decision row per sign-up.

    ``signups``: user_name, trigger_source, email, email_verified, and any
    identifying columns, which are kept.
    """
    gated = allowlist_gate(signups.withColumn("trigger_source", F.coalesce("trigger_source", F.lit(""))), allowlist)
    provider = keys.provider_of(F.col("user_name"))
    action = (
        F.when(F.col("blocked"), F.lit("blocked"))
        .when(F.col("trigger_source") != fv.EXTERNAL_TRIGGER, F.lit("untouched"))
        .when(
            ~F.col("email_verified").eqNullSafe(F.lit("true")) | (F.coalesce("email", F.lit("")) == ""),
            F.lit("skip_unverified"),
        )
        .when(~F.coalesce(provider.isin(*fv.TRUSTED_PROVIDERS), F.lit(False)), F.lit("skip_untrusted"))
        .when(F.col("destination_user").isNull(), F.lit("skip_no_unique_match"))
        .otherwise(F.lit("link"))
    )
    linked = F.col("action") == "link"
    kept = [c for c in signups.columns]
    return (
        gated.join(unique_native_match(directory), "email", "left")
        .withColumn("action", action)
        .select(
            *kept,
            "action",
            F.when(linked, F.col("destination_user")).alias("destination_user"),
            F.when(linked, provider).alias("provider"),
            F.when(linked, keys.subject_of(F.col("user_name"))).alias("subject"),
            linked.alias("auto_confirm"),
            linked.alias("auto_verify"),
        )
    )
