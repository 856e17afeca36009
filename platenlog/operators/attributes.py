"""Attribute tables: folding, typing, first-wins look-ups and attribute queries.

``tokens`` is a long table ``msg, grp, pos, tag, name, value`` in which a value
added to an attribute has an empty name; ``attributes`` is ``msg, group_pos,
delimiter, attr_pos, name, value_pos, tag, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.functions import codes
from platenlog.functions.device import device_time
from platenlog.functions.numbers import be_int, be_uint
from platenlog.operators.ordering import BLOCK_BITS, running_sum, tasks_for


def explode_attributes(decoded: DataFrame, *keys: str) -> DataFrame:
    """One row per message, group, attribute and value; values with no attribute before them are dropped."""
    # The names of the attributes, once each; a value finds that of its own by number.
    names = F.transform(F.filter("tokens", lambda t: (t["attr_no"] > 0) & (t["value_pos"] == 1)), lambda t: t["name"])
    held = decoded.select(*keys, names.alias("_names"), "tokens")
    values = held.select(*keys, "_names", F.inline("tokens")).where(F.col("attr_pos") > 0)
    own = [c for c in values.columns if c not in ("pos", "attr_no", "_names")]
    return values.withColumn("name", F.get("_names", F.col("attr_no") - 1)).select(*own)


def value_islands(tokens: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``attr_pos``: how many named tokens the group has had so far (0 before the first).

    Tokens are counted first, so that no task sorts more of a larger table.
    """
    return _islands(tokens, block_bits, tasks_for(tokens))


def _islands(tokens: DataFrame, block_bits: int, tasks: int | None) -> DataFrame:
    named = F.when(F.col("name") != "", 1).otherwise(0)
    return running_sum(tokens, ["msg", "grp"], "pos", named, "attr_pos", block_bits, tasks=tasks)


def collect_values(islands: DataFrame, keys: list[str], order: str, value: Column | str) -> DataFrame:
    """The values of each attribute, in order, as one array; a message body bounds its length."""
    column = F.col(value) if isinstance(value, str) else value
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), column.alias("v"))))
    return islands.groupBy(*keys).agg(
        F.max("name").alias("name"), F.transform(pairs, lambda p: p["v"]).alias("values")
    )


def group_values(tokens: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Fold values with an empty name into the attribute before them; leading ones are dropped."""
    tasks = tasks_for(tokens)
    islands = _islands(tokens, block_bits, tasks).where(F.col("attr_pos") > 0)
    if tasks:
        islands = islands.repartition(tasks, "msg", "grp", "attr_pos")
    value = F.struct("tag", "value")
    return collect_values(islands, ["msg", "grp", "attr_pos"], "pos", value)


def _bytes(value: Column, start: int, width: int) -> Column:
    return F.substr(value, F.lit(start), F.lit(width))


def typed_values(tokens: DataFrame, value: str = "value") -> DataFrame:
    """Add one typed column per value family, filled according to the tag."""
    tag, v = F.col("tag"), F.col(value)

    def uint(start: int, width: int) -> Column:
        return be_uint(_bytes(v, start, width)).cast("int")

    def int32(start: int) -> Column:
        return be_int(_bytes(v, start, 4)).cast("int")

    date_time = F.struct(
        uint(1, 2).alias("year"),
        *[
            uint(at, 1).alias(name)
            for at, name in enumerate(
                [
                    "month", "day", "hour", "minutes", "seconds", "deci_seconds",
                    "direction", "offset_hours", "offset_minutes",
                ],
                start=3,
            )
        ],
    )
    resolution = F.struct(int32(1).alias("cross_feed"), int32(5).alias("feed"), uint(9, 1).alias("units"))
    int_range = F.struct(int32(1).alias("lower"), int32(5).alias("upper"))
    other = ~tag.isin(
        codes.INTEGER, codes.BOOLEAN, codes.ENUM, codes.DATE_TIME, codes.RESOLUTION, codes.RANGE_OF_INTEGER,
        *codes.STRING_TAGS, *codes.OUT_OF_BAND_TAGS,
    )
    # An empty boolean is false: the hex of no bytes is no number.
    truth = F.coalesce(F.when(F.octet_length(v) > 0, uint(1, 1) != 0), F.lit(False))
    typed = tokens.withColumns(
        {
            "int_value": F.when(tag.isin(codes.INTEGER, codes.ENUM), int32(1)),
            "bool_value": F.when(tag == codes.BOOLEAN, truth),
            "str_value": F.when(tag.isin(*codes.STRING_TAGS), v.cast("string")),
            "bin_value": F.when(other, v),
            "datetime": F.when(tag == codes.DATE_TIME, date_time),
            "resolution": F.when(tag == codes.RESOLUTION, resolution),
            "int_range": F.when(tag == codes.RANGE_OF_INTEGER, int_range),
        }
    )
    return typed.withColumn("instant", device_time("datetime"))


def first_group(attributes: DataFrame, delimiter: int = codes.OPERATION_GROUP) -> DataFrame:
    """Only the attributes of the first group with that delimiter, per message.

    One shuffle by message, whose rows a message body bounds; the two look-ups
    below do without the rows and combine before the shuffle.
    """
    same = attributes.where(F.col("delimiter") == delimiter)
    first = F.min("group_pos").over(W.partitionBy("msg"))
    return same.withColumn("_first", first).where(F.col("group_pos") == F.col("_first")).drop("_first")


def first_value(
    attributes: DataFrame, name: str, tags: list[int], default, delimiter: int = codes.OPERATION_GROUP
) -> DataFrame:
    """Per message, the first value of the first attribute of that name in its first group of that delimiter.

    A wrong type falls to the default, it does not look further. One row per
    message that has such a group, whether or not it has the attribute: the aggregate
    combines on the map side, so a message of any length sends on one row.
    """
    hit = F.col("name") == name
    order = F.when(hit, F.struct("group_pos", "attr_pos", "value_pos"))
    found = F.min_by(F.when(hit, F.struct("group_pos", "tag", "value")), order)
    per_message = (
        attributes.where(F.col("delimiter") == delimiter)
        .groupBy("msg")
        .agg(found.alias("_found"), F.min("group_pos").alias("_first"))
    )
    # The first of all hits is in the first group, or that group has none.
    value = F.when(
        (F.col("_found.group_pos") == F.col("_first")) & F.col("_found.tag").isin(*tags), F.col("_found.value")
    )
    return per_message.select("msg", F.coalesce(value, F.lit(default)).alias("value"))


def requested_attributes(attributes: DataFrame) -> DataFrame:
    """Per message, what it asked for: ``wanted`` is NULL when it asked for everything by naming nothing.

    All attributes of the name and all their values count, keywords only.
    """
    word = F.when((F.col("name") == "requested-attributes") & (F.col("tag") == codes.KEYWORD), F.col("value"))
    words = F.collect_set(word)
    return (
        attributes.where(F.col("delimiter") == codes.OPERATION_GROUP)
        .groupBy("msg", "group_pos")
        .agg(words.alias("_words"))
        .groupBy("msg")
        .agg(F.min_by("_words", "group_pos").alias("_words"))
        .select("msg", F.when(F.size("_words") > 0, F.col("_words")).alias("wanted"))
    )


def is_wanted(wanted: Column, name: Column) -> Column:
    """Whether a request's list covers a name; no list and ``all`` cover everything."""
    return (
        wanted.isNull()
        | (F.size(wanted) == 0)
        | F.array_contains(wanted, "all")
        | F.array_contains(wanted, name)
    )


def attribute_query(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """What each request is told of its device: one row per value asked for.

    ``requests`` has ``seq, device_id, wanted``; ``devices`` one row per device
    with its attributes as an array. The join moves one row per request, the
    array is filtered in place and only what is wanted is exploded. Requests
    sit on the streamed side, where a much-asked device is split.

    Size estimates are far too low for array columns, and a broadcast chosen by
    them is not taken back at run time, so the join is told to be a merge join:
    what it moves of a request is a few values.
    """
    asked = requests.select("seq", "device_id", "wanted")
    held = devices.select(F.col("device_id").alias("_device"), "attributes").hint("merge")
    wanted = F.col("wanted")
    mine = F.filter("attributes", lambda a: is_wanted(wanted, a["name"]))
    return (
        asked.join(held, F.col("device_id") == F.col("_device"))
        .select("seq", "device_id", F.inline(mine))
        .select("seq", "device_id", "pos", "name", F.posexplode("values").alias("value_pos", "_v"))
        .select("seq", "device_id", "pos", "name", (F.col("value_pos") + 1).alias("value_pos"), "_v.tag", "_v.value")
    )
