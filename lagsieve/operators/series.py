"""Channels as arrays: the form in which kernels take a panel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Panels up to this size are sent to the executors once; larger ones are joined to the tasks.
SHARED_BYTES = 64 << 20


def series(panel: DataFrame) -> DataFrame:
    """(ch, z): each channel's values in order of t. One row a channel; a channel's length is the panel's, not the data's."""
    rows = panel.groupBy("ch").agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("r"))
    return rows.select("ch", F.col("r.z").alias("z"))


class Shared:
    """The series of a panel for tasks that name channels: broadcast if the panel is small (its rows are counted first), joined to each task otherwise."""

    def __init__(self, panel: DataFrame):
        self.series, self.sent = series(panel), None
        if panel.count() * 8 <= SHARED_BYTES:
            arrays = {r["ch"]: np.asarray(r["z"], float) for r in self.series.collect()}
            self.sent = panel.sparkSession.sparkContext.broadcast(arrays)

    def join(self, tasks: DataFrame, channel: str, name: str) -> DataFrame:
        """Tasks with the series of their channel, unless it's on the executors anyway."""
        if self.sent is not None:
            return tasks
        return tasks.join(self.series.select(F.col("ch").alias(channel), F.col("z").alias(name)), channel)

    def getter(self):
        """A function (task, channel's column, series' column) -> array, for the executors."""
        sent = self.sent

        def get(task, channel: str, name: str) -> np.ndarray:
            return np.asarray(getattr(task, name), float) if sent is None else sent.value[getattr(task, channel)]

        return get
