"""Settings from an INI file, the environment and arguments, in this order of precedence from low to high."""

from __future__ import annotations

import configparser
import dataclasses
import logging
import logging.handlers
import os

from pyspark.sql import SparkSession


@dataclasses.dataclass(frozen=True)
class Settings:
    """batch: rows of a part. mode: independent or adaptive. log_level: of this package and of Spark. log_file: where the
    package's records go, besides the console; it is rolled over at log_bytes. log_format: a pattern of logging."""

    batch: int = 1_000_000
    mode: str = "independent"
    shuffle_partitions: int = 0
    log_level: str = "WARN"
    log_file: str = ""
    log_bytes: int = 50_000_000
    log_format: str = "[%(levelname)s][%(asctime)s][%(name)s] %(message)s"

    @staticmethod
    def load(path: str | None = None, **given) -> Settings:
        """The section [tidepack] of the file, TIDEPACK_* of the environment, then what is given."""
        found: dict[str, object] = {}
        if path:
            parser = configparser.ConfigParser(interpolation=None)
            with open(path) as f:
                parser.read_file(f)
            found |= parser["tidepack"] if "tidepack" in parser else {}
        kinds = {f.name: type(f.default) for f in dataclasses.fields(Settings)}
        found |= {k: os.environ[f"TIDEPACK_{k.upper()}"] for k in kinds if f"TIDEPACK_{k.upper()}" in os.environ}
        found |= {k: v for k, v in given.items() if v is not None}
        if unknown := found.keys() - kinds.keys():
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Settings(**{k: kinds[k](v) for k, v in found.items()})

    def apply(self, spark: SparkSession) -> SparkSession:
        if self.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", self.shuffle_partitions)
        spark.sparkContext.setLogLevel(self.log_level)
        log = logging.getLogger("tidepack")
        log.setLevel("WARNING" if self.log_level == "WARN" else self.log_level)
        for old in log.handlers[:]:
            log.removeHandler(old)
            old.close()
        sinks = [logging.StreamHandler()]
        if self.log_file:
            sinks.append(logging.handlers.RotatingFileHandler(self.log_file, maxBytes=self.log_bytes, backupCount=1, delay=True))
        for sink in sinks:
            sink.setFormatter(logging.Formatter(self.log_format))
            log.addHandler(sink)
        return spark
