"""Users, settings and request parameters: scans, projections without secrets, coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a user that leave the library; password, salt and token never do.
PUBLIC = ("username", "enable_webdav", "enable_local_store", "book_limit", "last_login_at", "created_at")


def admin_view(users: DataFrame) -> DataFrame:
    """All users as an administrator sees them, by name."""
    return users.select(*PUBLIC).orderBy("username")


def login_view(users: DataFrame) -> DataFrame:
    """What a login returns: the public columns and ``access_token``, the name and token joined by a colon."""
    return users.select(*PUBLIC, F.concat(F.col("username"), F.lit(":"), F.coalesce("token", F.lit(""))).alias("access_token"))


def found(users: DataFrame, name: str) -> DataFrame:
    """The user of a name, one row or none."""
    return users.where(F.col("username") == name).limit(1)


def setting(settings: DataFrame, key: str) -> DataFrame:
    """One row ``value, found``: a setting's value, or null and false."""
    return settings.where(F.col("key") == key).agg(F.max("value").alias("value"), (F.count("*") > 0).alias("found"))


def settings(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` with ``value, found`` of their ``key``; a key that isn't stored has null and false."""
    own = stored.groupBy("key").agg(F.max("value").alias("value")).withColumn("found", F.lit(True))
    return asked.join(own, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def permissions_changed(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with the non-null permissions of ``changes``, and one row with the number of users that were matched.

    A change in which everything is null matches nobody.
    """
    from folio.operators.dml import updated

    given = [c for c in changes.columns if c != "username"]
    real = changes.where(F.coalesce(*(F.col(c).cast("string") for c in given)).isNotNull())
    matched = users.join(real.select("username").distinct(), "username", "left_semi").agg(F.count("*").alias("matched"))
    return updated(users, real, ["username"]), matched


def _kind(params: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(params), f"$.{key}", "variant"))


def string_param(params: Column, key: str) -> Column:
    """A parameter of a JSON object that is a string; anything else is the empty string."""
    return F.coalesce(F.when(_kind(params, key) == "STRING", F.get_json_object(params, f"$.{key}")), F.lit(""))


def bool_param(params: Column, key: str) -> Column:
    """A boolean, or whether a string is ``true`` or ``1``; null where it is neither a boolean nor a string."""
    value, kind = F.get_json_object(params, f"$.{key}"), _kind(params, key)
    return F.when(kind == "BOOLEAN", value == "true").when(kind == "STRING", value.isin("true", "1"))


def int_param(params: Column, key: str) -> Column:
    """A number cut to a whole one, or a string of digits with a sign; else null."""
    value, kind = F.get_json_object(params, f"$.{key}"), _kind(params, key)
    number = F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(F.try_parse_json(params), f"$.{key}", "double").cast("long"))
    return F.when(kind == "STRING", F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))).otherwise(number)
