"""Event streams: an extension, for timelines that arrive while they are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n, total) of runs of events (user_id, ts, value) that are less than gap apart.

    The same for a table and a stream. In a stream a session is given once no event that is late by at most that long can
    join it; later ones are dropped, and state goes with the sessions. Rows without a time have no session.
    """
    w = F.session_window("ts", gap)
    each = events.where("ts IS NOT NULL").withWatermark("ts", late).groupBy("user_id", w.alias("w"))
    return each.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
