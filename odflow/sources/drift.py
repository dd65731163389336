"""JSON inputs whose shape drifts: VARIANT columns, and what cannot be read is kept with its reason.

A field that is missing, added or of another type neither fails a job nor turns a whole record into nulls. Every
payload is parsed once; each item ends either as a row or as a reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.sources.tables import event_date

NOT_JSON, NOT_A_LIST = "not JSON", "not a list"
NO_DATE, WRONG_TYPE, NO_SUCH_DAY = "no date", "wrong type", "no such day"
NO_ENTITIES, NO_DELAY = "no entities", "no delay"


def kind(value: Column) -> Column:
    """First word of the type of a VARIANT: OBJECT, ARRAY, STRING, BIGINT, VOID ...; null for a missing one."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def parsed(rows: DataFrame, payload: str) -> DataFrame:
    """Add ``_json``, the payload as VARIANT, null where it is not JSON."""
    return rows.withColumn("_json", F.try_parse_json(F.col(payload)))


def listed(value: Column) -> Column:
    """The items of a JSON list as an array of VARIANT, null for anything else."""
    return F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def read_events(payloads: DataFrame, payload: str) -> DataFrame:
    """``(payload, item, event_date, reason)``: one row per list item, or per payload that is no list.

    Exactly one of ``event_date`` and ``reason`` is set. ``item`` is the item's JSON. Empty lists give no row. Fields besides
    ``event_start_date`` may be there or not.
    """
    items = parsed(payloads.select(F.col(payload).alias("payload")), "payload").select(
        "payload", "_json", listed(F.col("_json")).alias("_items")
    )
    whole = F.when(F.col("_json").isNull(), NOT_JSON).when(F.col("_items").isNull(), NOT_A_LIST)
    rows = items.select("payload", whole.alias("_whole"), F.explode(F.when(whole.isNotNull(), F.array(F.col("_json"))).otherwise(F.col("_items"))).alias("_item"))
    start = F.try_variant_get("_item", "$.event_start_date", "variant")
    rows = rows.withColumn("_kind", kind(start))
    text = F.when(F.col("_kind") == "STRING", F.try_variant_get("_item", "$.event_start_date", "string"))
    rows = rows.withColumn("event_date", F.when(F.col("_whole").isNull(), event_date(text)))
    missing = F.col("_kind").isNull() | (F.col("_kind") == "VOID")
    reason = (
        F.when(F.col("_whole").isNotNull(), F.col("_whole"))
        .when(missing, NO_DATE)
        .when(F.col("_kind") != "STRING", WRONG_TYPE)
        .when(F.col("event_date").isNull(), NO_SUCH_DAY)
    )
    return rows.select("payload", F.to_json("_item").alias("item"), "event_date", reason.alias("reason"))


def read_trip_updates(messages: DataFrame, payload: str, *keep: str) -> DataFrame:
    """``(*keep, trip_id, stop_id, delay, payload, reason)``: a row per stop update, good or rejected.

    Works on batches and streams. A delay may be a number or a number as text; ids may be numbers. Updates of entities of
    other kinds (no ``trip_update``) are passed over; an update without a readable delay, and a message that is no JSON
    or has no list of entities, is a reject with the message as ``payload``.
    """
    wide = parsed(messages.select(*keep, F.col(payload).alias("payload")), "payload")
    entities = listed(F.try_variant_get("_json", "$.entity", "variant"))
    whole = F.when(F.col("_json").isNull(), NOT_JSON).when(entities.isNull(), NO_ENTITIES)
    wide = wide.select(*keep, "payload", whole.alias("_whole"), F.explode_outer(entities).alias("_entity"))
    updates = listed(F.try_variant_get("_entity", "$.trip_update.stop_time_update", "variant"))
    trip = F.try_variant_get("_entity", "$.trip_update.trip.trip_id", "string")
    wide = wide.select(*keep, "payload", "_whole", trip.alias("trip_id"), F.explode_outer(updates).alias("_update"))
    rows = wide.filter(F.col("_whole").isNotNull() | F.col("_update").isNotNull()).withColumns({
        "stop_id": F.try_variant_get("_update", "$.stop_id", "string"),
        "delay": F.try_variant_get("_update", "$.arrival.delay", "double"),
    })
    reason = F.coalesce("_whole", F.when(F.col("delay").isNull(), NO_DELAY))
    return rows.select(*keep, "trip_id", "stop_id", "delay", "payload", reason.alias("reason"))


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without ``payload``, ``item`` and ``reason``; rejects with payload and reason."""
    good = rows.filter(F.col("reason").isNull()).drop("payload", "item", "reason")
    return good, rows.filter(F.col("reason").isNotNull()).select("payload", "reason")
