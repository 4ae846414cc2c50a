"""Sessions and their validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Settings of every session; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.shuffle.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


class ConfigError(ValueError):
    """Settings that exclude each other."""


def validate(conf: dict[str, str]) -> dict[str, str]:
    """Check what the exchange needs; returns the settings unchanged.

    A durable exchange keeps results in shared storage, so an external shuffle service must be off, and
    so must the old fetch protocol, which cannot name the blocks of a batch.
    """
    on = lambda key: str(conf.get(key, "false")).lower() == "true"
    durable = bool(conf.get("spark.checkpoint.dir"))
    if durable and on("spark.shuffle.service.enabled"):
        raise ConfigError("spark.shuffle.service.enabled excludes a durable exchange")
    if durable and on("spark.shuffle.useOldFetchProtocol"):
        raise ConfigError("spark.shuffle.useOldFetchProtocol excludes batched fetches")
    if "spark.shuffle.sort.bypassMergeThreshold" in conf and int(conf["spark.shuffle.sort.bypassMergeThreshold"]) < -1:
        raise ConfigError("spark.shuffle.sort.bypassMergeThreshold is -1 (never) or a number of partitions")
    return conf


@dataclass(frozen=True)
class Exchange:
    """Typed settings of the exchange; ``conf()`` gives Spark's own keys, checked."""

    shared_dir: str | None = None
    replication: int | None = None
    bypass_threshold: int = -1
    max_bytes_in_flight: str = "48m"
    max_requests_in_flight: int = 2**31 - 1
    max_blocks_per_address: int = 2**31 - 1
    detect_corrupt: bool = True
    extra_memory_for_corrupt: bool = False
    compress: bool = True
    codec: str = "lz4"
    file_buffer: str = "32k"
    spill_batch: int = 10_000
    radix_sort: bool = True
    fast_merge: bool = True
    fallback_path: str | None = None
    #: Of reads from shared storage: bytes of a read's first request and of one task's input, tries and the wait between them.
    first_read: str = "4m"
    max_read: str = "128m"
    io_threads: int = 8
    max_retries: int = 3
    retry_wait: str = "5s"
    memory_fraction: float = 0.6
    max_map_retries: int = 4

    def conf(self) -> dict[str, str]:
        if min(self.max_requests_in_flight, self.max_blocks_per_address, self.spill_batch) < 1:
            raise ConfigError("requests in flight, blocks per address and the spill batch are at least 1")
        if self.replication is not None and self.replication < 1:
            raise ConfigError("the replication is at least 1")
        if min(self.io_threads, self.max_map_retries) < 1 or self.max_retries < 0:
            raise ConfigError("threads and map tries are at least 1, read retries not negative")
        if not 0 < self.memory_fraction < 1:
            raise ConfigError("the memory fraction lies between 0 and 1")
        text = lambda x: str(x).lower()
        found = {
            "spark.shuffle.sort.bypassMergeThreshold": text(self.bypass_threshold),
            "spark.reducer.maxSizeInFlight": self.max_bytes_in_flight,
            "spark.reducer.maxReqsInFlight": text(self.max_requests_in_flight),
            "spark.reducer.maxBlocksInFlightPerAddress": text(self.max_blocks_per_address),
            "spark.shuffle.detectCorrupt": text(self.detect_corrupt),
            "spark.shuffle.detectCorrupt.useExtraMemory": text(self.extra_memory_for_corrupt),
            "spark.shuffle.compress": text(self.compress),
            "spark.io.compression.codec": self.codec,
            "spark.shuffle.file.buffer": self.file_buffer,
            "spark.shuffle.spill.batchSize": text(self.spill_batch),
            "spark.shuffle.sort.useRadixSort": text(self.radix_sort),
            "spark.shuffle.unsafe.fastMergeEnabled": text(self.fast_merge),
            "spark.sql.files.openCostInBytes": self.first_read,
            "spark.sql.files.maxPartitionBytes": self.max_read,
            "spark.shuffle.io.serverThreads": text(self.io_threads),
            "spark.shuffle.io.clientThreads": text(self.io_threads),
            "spark.shuffle.io.maxRetries": text(self.max_retries),
            "spark.shuffle.io.retryWait": self.retry_wait,
            "spark.memory.fraction": text(self.memory_fraction),
            "spark.task.maxFailures": text(self.max_map_retries),
        }
        if self.shared_dir:
            found["spark.checkpoint.dir"] = self.shared_dir
        if self.replication:
            found["spark.hadoop.dfs.replication"] = text(self.replication)
        if self.fallback_path:
            found |= {"spark.storage.decommission.fallbackStorage.path": self.fallback_path, "spark.decommission.enabled": "true", "spark.storage.decommission.enabled": "true", "spark.storage.decommission.shuffleBlocks.enabled": "true"}
        return validate(found)


def session(name: str = "weirflow", **conf: str) -> SparkSession:
    """A session with DEFAULTS and the given settings (dots as double underscores)."""
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=validate(settings)).getOrCreate()
