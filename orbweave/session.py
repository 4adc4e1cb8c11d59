"""Session settings and the two ways lineage is cut: a checkpoint, and the written steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "orbweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; master and partitions only where the caller gives them."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orbweave-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: survives lost executors, ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Settings for the steps of an iteration: no query stages of their own, and no constraints inherited from step to step,
#: which double with every renamed column until the driver runs out of memory.
STEP_SETTINGS = {"spark.sql.adaptive.enabled": "false", "spark.sql.constraintPropagation.enabled": "false"}


class Steps:
    """The steps of an iteration, written as tables into the shared checkpoint folder.

    Tables, as a checkpoint would hand on its plan's size estimate, and the product of two estimates a join grows to millions of
    digits within some twenty rounds. Steps are planned in a session of their own, so the caller's settings are never
    touched; `take` brings a frame in, `give` hands one back. A step is deleted by `drop` once its successors are written.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.caller = spark
        self.spark = spark.newSession()
        for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            self.spark.conf.set(k, spark.conf.get(k))
        for k, v in STEP_SETTINGS.items():
            self.spark.conf.set(k, v)
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.written: dict[int, tuple[DataFrame, str]] = {}

    def _save(self, df: DataFrame, reader: SparkSession) -> tuple[DataFrame, str]:
        path = f"{self.spark.sparkContext.getCheckpointDir()}/orbweave-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return reader.read.schema(df.schema).parquet(path), path

    def take(self, df: DataFrame) -> DataFrame:
        """A frame of the caller as a step."""
        out, path = self._save(df, self.spark)
        self.written[id(out)] = (out, path)
        return out

    def write(self, df: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
        """A step and aggregates of its rows, gathered while they are written; each row of it is counted once."""
        df = df.coalesce(self.partitions)  # a step comes out of a shuffle; unions add up partitions from round to round
        seen = Observation()
        if what:
            df = df.observe(seen, *[c.alias(k) for k, c in what.items()])
        out, path = self._save(df, self.spark)
        self.written[id(out)] = (out, path)
        return out, seen.get if what else {}

    def drop(self, *steps: DataFrame) -> None:
        """Delete steps that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in steps:
            _, path = self.written.pop(id(df), (None, None))
            if path:
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)

    def give(self, df: DataFrame) -> DataFrame:
        """A frame of the iteration, back in the caller's session."""
        return self._save(df, self.caller)[0]
