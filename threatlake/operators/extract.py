"""Lines to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake import schemas
from threatlake.functions import events as ev
from threatlake.functions import text


def parse_events(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """Adds the event columns; Windows, ssh, JSON, generic in that order, first hit wins.

    Every line yields one event.  `details` is only set for generic lines.
    """
    line = F.col("line")
    staged = lines.withColumns({f"_{k}": c for k, c in ev.captures(line).items()})
    staged = staged.withColumns({
        **{f"_{k}": ev.complete(F.col(f"_{k}"), k) for k in ("created", "allowed", "ssh")}, "_texts": ev.json_texts(F.col("_json"))})
    parsed = F.coalesce(
        ev.process_created(F.col("_created")),
        ev.connection_allowed(F.col("_allowed")),
        ev.ssh_login(F.col("_ssh"), default_year),
        ev.json_network(F.col("_json"), default_year, F.col("_texts")),
        ev.json_process(F.col("_json"), default_year, F.col("_texts")),
        ev.generic(line),
    )
    # The generator keeps later filters on event columns from being inlined into the parsers; they are in a
    # projection of their own, which is compiled.
    staged = staged.select(*lines.columns, parsed.alias("_parsed"))
    return staged.select(*lines.columns, F.inline(F.array("_parsed")))


def with_details(events: DataFrame) -> DataFrame:
    """The details map of generic events: the whole line as `message`."""
    message: Column = F.create_map(F.lit("message"), F.col("line"))
    return events.withColumn("details", F.when(F.col("kind") == schemas.GENERIC, message))


def parse_packets(lines: DataFrame) -> DataFrame:
    """Packet-export lines as connection rows; other lines are left out."""
    # Thirteen fields are read from the captures: each would run the regex anew, and so would the filter.
    staged = text.computed_once(lines, "_parts", ev.packet_captures(F.col("line")))
    staged = staged.withColumn("_parts", ev.complete(F.col("_parts"), "packet"))
    staged = staged.withColumn("_packet", ev.packet(F.col("_parts"))).filter("_packet is not null")
    return staged.select(*lines.columns, "_packet.*")
