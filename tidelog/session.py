"""Session settings, states of a log, and durable intermediate tables."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession

from .errors import LogClosed, LogDraining, LogNotRunning, LogStateError

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Sets what the engine expects of a session."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own where a local session names none (tests). A cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "/tmp/tidelog-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder: what follows sees one version of the rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class State(IntEnum):
    """States of a log, forward only."""

    INIT = 0
    RUNNING = 1
    DRAINING = 2
    CLOSED = 3


class Lifecycle:
    def __init__(self):
        self.state = State.INIT

    def advance(self, to: State) -> None:
        if to <= self.state:
            raise LogStateError(f"{self.state.name} doesn't lead to {to.name}")
        self.state = to

    def must_write(self) -> None:
        if self.state is not State.RUNNING:
            raise {State.INIT: LogNotRunning, State.DRAINING: LogDraining, State.CLOSED: LogClosed}[self.state](self.state.name)

    def must_read(self) -> None:
        if self.state not in (State.RUNNING, State.DRAINING):
            raise (LogClosed if self.state is State.CLOSED else LogNotRunning)(self.state.name)
