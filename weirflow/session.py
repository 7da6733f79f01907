"""Sessions, settings and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Settings:
    """What a job can be given; ``conf()`` has it as Spark settings.

    Hosts, ports, slots and heartbeats of a cluster are Spark's own business and
    go through ``extra`` (any Spark setting). Intervals, watermarks and the message
    bus are taken by ``Environment``.
    """

    job_name: str = "job"
    master: str | None = None
    parallelism: int | None = None
    memory_mb: int | None = None
    checkpoint_interval_ms: int = 10_000
    checkpoint_dir: str | None = None
    state_backend: str = "rocksdb"
    kafka_servers: str = "localhost:9092"
    kafka_group_prefix: str = "weirflow"
    watermark_interval_ms: int = 200
    watermark_delay_ms: int = 5_000
    max_records_per_trigger: int | None = None
    rocksdb_write_buffer_mb: int = 64
    rocksdb_max_write_buffers: int = 3
    rocksdb_block_cache_mb: int = 256
    extra: dict[str, str] = field(default_factory=dict)

    def update(self, values: dict) -> Settings:
        """A copy with some settings changed; unknown names are an error."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **values)

    def kafka(self) -> dict:
        """What ``readers.kafka`` takes of these settings."""
        return {"servers": self.kafka_servers, "group_prefix": self.kafka_group_prefix, "max_per_trigger": self.max_records_per_trigger}

    def conf(self) -> dict[str, str]:
        if self.state_backend not in ("rocksdb", "memory"):
            raise ValueError(f"state_backend must be rocksdb or memory, not {self.state_backend!r}")
        rocks = "spark.sql.streaming.stateStore.rocksdb."
        out = {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.streaming.multipleWatermarkPolicy": "min",
            rocks + "writeBufferSizeMB": str(self.rocksdb_write_buffer_mb),
            rocks + "maxWriteBufferNumber": str(self.rocksdb_max_write_buffers),
            rocks + "blockCacheSizeMB": str(self.rocksdb_block_cache_mb),
            rocks + "changelogCheckpointing.enabled": "true",
        }
        if self.state_backend == "rocksdb":
            out["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB
        if self.parallelism:
            out["spark.sql.shuffle.partitions"] = str(self.parallelism)
        if self.memory_mb:
            out["spark.executor.memory"] = f"{self.memory_mb}m"
        if self.checkpoint_dir:
            out["spark.checkpoint.dir"] = self.checkpoint_dir
        return out | self.extra


def session(settings: Settings | None = None) -> SparkSession:
    """A session with the settings (or the one that is running, given those that can be changed)."""
    settings = settings or Settings()
    builder = SparkSession.builder.appName(settings.job_name)
    if settings.master:
        builder = builder.master(settings.master)
    return builder.config(map=settings.conf()).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere what queries rely on: UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def keyed_store(spark: SparkSession) -> None:
    """Keyed processors on streams need RocksDB; called where one is made."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_weirflow_shipped", False):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="weirflow-")) / "weirflow.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("weirflow") / file.relative_to(root))
    sc.addPyFile(str(path))
    sc._weirflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local master gets a temporary folder, as in tests; on a
    cluster that is an error, as executors would not see the driver's folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='weirflow-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
