"""Sessions by profile. A profile is data: shuffle width, files for each micro-batch, join hint and trigger."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Profile:
    trigger: str
    files_per_trigger: int
    shuffle_partitions: int
    broadcast_zones: bool
    producer_batch_bytes: int
    producer_linger_ms: int
    producer_compression: str


#: The two tuning profiles whose figures are compared.
PROFILES = {
    "v1": Profile("10 seconds", 1, 200, False, 16384, 0, "none"),
    "v2": Profile("5 seconds", 16, 8, True, 65536, 50, "gzip"),
}


def settings(profile: str = "v2") -> dict[str, str]:
    """Spark settings of a profile."""
    return {
        "spark.sql.shuffle.partitions": str(PROFILES[profile].shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.schemaInference": "false",
        "spark.sql.streaming.minBatchesToRetain": "2",
        "spark.driver.memory": "4g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def session(profile: str = "v2", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("weftline").config(map=settings(profile) | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def logger(name: str, file: str | None = None) -> logging.Logger:
    """A logger of the driver to the console and, if named, a file; asked for again, it is the same one."""
    log = logging.getLogger(f"weftline.{name}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        for handler in [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]:
            handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            log.addHandler(handler)
    return log
