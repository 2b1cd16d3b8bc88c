"""Filters of catalog lists and of searches. Each is optional; without any, all rows stay. A row for which a condition can't be told goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import present, seconds_of

EMPTY = "(empty)"  # asks for rows that have nothing there
#: Seconds from which on a recording is of a length, and up to which.
LENGTHS = {"short": (0, 1800), "medium": (1800, 3600), "long": (3600, None)}


def _is(column: str, value) -> Column:
    return F.col(column).isNull() if value == EMPTY else F.col(column) == value


def entries(df: DataFrame, status: str | None = None, actionable_only: bool = False, verified: bool | None = None, artist: str | None = None, album=None, duration: str | None = None, recorder=None, location=None, part=None, year=None, month=None, day=None, duplicates: int | None = None) -> DataFrame:
    """Catalog entries (is_actionable, is_published, verified, artist, album_id, duration, recorder_id, location_id, part, date_year, date_month, date_day, duplicate_count) that fit.

    status: `ready` is actionable and published, `incomplete` is not; with neither, actionable_only may ask for less. artist: part of the name in any case. EMPTY asks
    for entries without an artist, album, recorder, location, part or year. A duration that isn't HH:MM:SS has no length. A month counts only
    with a year, a day only with both.
    """
    ready = F.coalesce(F.col("is_actionable") & F.col("is_published"), F.lit(False))
    rules = []
    if status in ("ready", "incomplete"):
        rules.append(ready if status == "ready" else ~ready)
    elif actionable_only:
        rules.append(F.col("is_actionable"))
    if verified is not None:
        rules.append(F.coalesce("verified", F.lit(False)) == verified)
    if artist:
        rules.append(present("artist").isNull() if artist == EMPTY else F.contains(F.lower("artist"), F.lit(artist.lower())))
    if duration in LENGTHS:
        least, most = LENGTHS[duration]
        length = seconds_of(F.col("duration"))
        rules.append((length >= least) & (F.lit(True) if most is None else length < most))
    rules += [_is(c, v) for c, v in (("album_id", album), ("recorder_id", recorder), ("location_id", location), ("part", part)) if v is not None]
    if year == EMPTY:
        rules.append(F.coalesce("date_year", F.lit(0)) == 0)
    elif year:
        rules += [F.col("date_year") == year, *([F.col("date_month") == month] if month else []), *([F.col("date_day") == day] if month and day else [])]
    if duplicates is not None:
        rules.append(F.col("duplicate_count") == duplicates)
    for rule in rules:
        df = df.where(rule)
    return df


def searchable(recordings: DataFrame, links: DataFrame, events: DataFrame, hashes: list | None = None, event_ids: list | None = None, locations: list | None = None, recorders: list | None = None, years: list | None = None, verified: bool | None = None, secondary: bool = False) -> DataFrame:
    """The audio_hash, each once, of recordings (audio_hash, recorder_id, verified) that a search may find, by their links (audio_hash, event_id, is_primary) to events (event_id, location_id, date_year).

    Unless secondary recordings are asked for, or recordings by name, one that is linked must be the primary one of an event. Conditions on an event are those of one and the same event. Empty lists
    ask for nothing.
    """
    if hashes:
        recordings = recordings.where(F.col("audio_hash").isin(hashes))
    if recorders:
        recordings = recordings.where(F.col("recorder_id").isin(recorders))
    if verified is not None:
        recordings = recordings.where(F.col("verified") == verified)
    if not secondary and not hashes:
        state = links.groupBy(F.col("audio_hash").alias("l_hash")).agg(F.max(F.coalesce("is_primary", F.lit(False))).alias("primary"))
        recordings = recordings.join(state, F.col("audio_hash") == F.col("l_hash"), "left").where("l_hash IS NULL OR primary")
    asked = [F.col(c).isin(v) for c, v in (("event_id", event_ids), ("location_id", locations), ("date_year", years)) if v]
    if asked:
        linked = links.select(F.col("audio_hash").alias("e_hash"), "event_id").join(events, "event_id")
        for rule in asked:
            linked = linked.where(rule)
        recordings = recordings.join(linked, F.col("audio_hash") == F.col("e_hash"), "left_semi")
    return recordings.select("audio_hash").distinct()
