"""Nested values out of the flat tokens of a decoded message.

On the wire a collection is flat: a begin value, then for each member its name as a
value and the values it has, then an end value. Decoding keeps it that way. Here the
depth of each value is a running sum over begins and ends, and every value learns the
collection and the member it belongs to, as rows of one long table. No level is
walked by itself, so collections may be nested to any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.functions import codes
from platenlog.functions.device import media_dims
from platenlog.functions.numbers import be_int

ATTRIBUTE = ["group_pos", "attr_pos"]


def nested_values(values: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Every value of exploded attributes with its place among collections.

    ``values`` are rows of ``explode_attributes`` with the message's ``keys``. Returned are the keys,
    ``group_pos, delimiter, attr_pos, name``, and

    - ``place``: the place of the value in its attribute, which also names the collection a begin value opens;
    - ``level``: how many collections are around it;
    - ``collection``: the ``place`` of the innermost of them, 0 at level 0;
    - ``member``: the name it has there, NULL at level 0 and for a value ahead of any name;
    - ``item``: which value of that member (at level 0: of the attribute) it is, from 1;
    - ``tag, value, opens``: as decoded, and whether it opens a collection.

    Ends and names are marks and no rows of their own. An end that closes nothing is passed
    over; a collection that is not closed holds what follows in its attribute. One shuffle by attribute, whose
    values a message body bounds, to ``tasks`` partitions if they
    are named (``ordering.tasks_for`` the messages: counting ``values`` would decode them).
    """
    tag = F.col("tag")
    own = [*keys, *ATTRIBUTE]
    if tasks:
        values = values.repartition(tasks, *own)
    wire = W.partitionBy(*own).orderBy("value_pos")
    step = F.when(tag == codes.BEGIN_COLLECTION, 1).when(tag == codes.END_COLLECTION, -1).otherwise(0)
    summed = values.withColumn("_sum", F.sum(step).over(wire))
    # An end that closes nothing lowers the sum for good; the lowest sum so far takes that back.
    depth = (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(wire))).cast("int")
    placed = summed.withColumn("_depth", depth).where(tag != codes.END_COLLECTION)
    # A begin is a value at the level around it, and opens the one inside.
    value, opener, mark = F.lit("value"), F.lit("opener"), F.lit("mark")

    def at_level(level: Column, role: Column) -> Column:
        return F.struct(level.alias("level"), role.alias("role"))

    here = F.col("_depth")
    roles = (
        F.when(tag == codes.BEGIN_COLLECTION, F.array(at_level(here - 1, value), at_level(here, opener)))
        .when((tag == codes.MEMBER_NAME) & (here > 0), F.array(at_level(here, mark)))
        .otherwise(F.array(at_level(here, value)))
    )
    rows = placed.select("*", F.inline(roles))
    level = W.partitionBy(*own, "level").orderBy("value_pos")
    opened = F.when(F.col("role") == "opener", F.col("value_pos"))
    # The last name, or the last opener, after which no member has been named.
    named = F.when(F.col("role") == "mark", F.struct("value_pos", F.col("value").cast("string").alias("name"))).when(
        F.col("role") == "opener", F.struct("value_pos", F.lit(None).cast("string").alias("name"))
    )
    held = (
        rows.withColumns(
            {
                "collection": F.coalesce(F.last(opened, ignorenulls=True).over(level), F.lit(0)),
                "_named": F.last(named, ignorenulls=True).over(level),
            }
        )
        .where(F.col("role") == "value")
        .withColumn("_since", F.coalesce("_named.value_pos", F.lit(0)))
    )
    item = F.row_number().over(W.partitionBy(*own, "level", "_since").orderBy("value_pos"))
    return held.withColumn("item", item).select(
        *keys,
        "group_pos",
        "delimiter",
        "attr_pos",
        "name",
        F.col("value_pos").alias("place"),
        "level",
        "collection",
        F.col("_named.name").alias("member"),
        "item",
        "tag",
        "value",
        (tag == codes.BEGIN_COLLECTION).alias("opens"),
    )


def collections_of(nested: DataFrame, member: str, fields: dict[str, int], *keys: str) -> DataFrame:
    """One row per collection that is a value of ``member``, at any level: where it is, and its ``fields`` as binary columns.

    ``fields`` are the names and the tags of members; of several values the first of that tag counts, a member that is
    missing or of other tags is NULL. A collection and what it holds meet in one aggregate, without a join.
    """
    own = F.col("opens") & F.col("member").eqNullSafe(member)
    part = F.col("member").isin(*fields) & (F.col("level") > 0)
    # A collection may be a member of its like, so a row may be looked for twice.
    sides = F.array_compact(
        F.array(
            F.when(own, F.struct(F.col("place").alias("held_at"), F.lit(True).alias("own"))),
            F.when(part, F.struct(F.col("collection").alias("held_at"), F.lit(False).alias("own"))),
        )
    )

    def first(name: str, tag: int) -> Column:
        return F.min_by("value", F.when(~F.col("own") & (F.col("member") == name) & (F.col("tag") == tag), F.col("place")))

    return (
        nested.where(own | part)
        .select(*keys, *ATTRIBUTE, "name", "place", "level", "collection", "member", "tag", "value", F.inline(sides))
        .groupBy(*keys, *ATTRIBUTE, "name", F.col("held_at").alias("place"))
        .agg(
            F.max("own").alias("_own"),
            F.max(F.when(F.col("own"), F.col("level"))).alias("level"),
            F.max(F.when(F.col("own"), F.col("collection"))).alias("collection"),
            *[first(name, tag).alias(name) for name, tag in fields.items()],
        )
        .where("_own")
        .drop("_own")
    )


def media_sizes(nested: DataFrame, *keys: str) -> DataFrame:
    """Every media size that a message names, wherever it is nested, in millimetres.

    ``width_mm`` or ``height_mm`` is NULL where the dimension is missing or no integer (a size may name a range).
    """
    sizes = collections_of(
        nested, "media-size", {"x-dimension": codes.INTEGER, "y-dimension": codes.INTEGER}, *keys
    )

    def number(name: str) -> Column:
        return be_int(F.substr(F.col(f"`{name}`"), F.lit(1), F.lit(4))).cast("int")

    size = F.struct(number("x-dimension").alias("x_dimension"), number("y-dimension").alias("y_dimension"))
    return sizes.select(*keys, *ATTRIBUTE, "name", "place", "level", F.inline(F.array(media_dims(size))))
