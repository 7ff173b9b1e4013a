"""Statute names as a table join: names meet aliases of their digits and of a near length, and the nearest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.functions import text as T


def name_key(name: Column) -> Column:
    """Folded words of a-z, 0-9 and slashes, one blank between."""
    return F.trim(F.regexp_replace(F.replace(T.fold(name), F.lit("º"), F.lit("o")), "[^a-z0-9/]+", " "))


def alias_table(spark: SparkSession) -> DataFrame:
    """(order, key, form, digits): a row for each name and numbered form of the fixed statutes; the order settles ties."""
    from lexspark.functions.spans import alias_forms

    return spark.createDataFrame([(i, key, form, "".join(c for c in form if c.isdigit())) for i, (key, form) in enumerate(alias_forms())], "order int, key string, form string, digits string")


def nearest_alias(names: DataFrame, aliases: DataFrame, tolerance: float = fixed.STATUTE_TOLERANCE) -> DataFrame:
    """names: (id, name) -> (id, key, distance) of the nearest alias within ``tolerance`` edits by its length; names with none are left out.

    An alias that has digits meets names of exactly these.  An alias is dealt to every
    length that a name within tolerance may have, so the join is one of equal keys.
    """
    reach = F.floor(F.length("form") * tolerance + 1e-9).cast("int")
    dealt = aliases.select("order", "key", "form", "digits", F.explode(F.sequence(F.length("form") - reach, F.length("form") + reach)).alias("n"))
    n = names.select("id", name_key(F.col("name")).alias("name")).where("name <> ''")
    own = n.select("id", "name", F.length("name").alias("n"), F.explode(F.array_distinct(F.array(F.lit(""), T.digits(F.col("name"))))).alias("digits"))
    distance = F.levenshtein("name", "form") / F.length("form")
    met = own.join(dealt, ["digits", "n"]).withColumn("distance", distance).where(F.col("distance") <= tolerance)
    best = met.groupBy("id").agg(F.min(F.struct(F.round("distance", 3).alias("d"), "order", "key", "distance")).alias("b"))
    return best.select("id", "b.key", "b.distance")
