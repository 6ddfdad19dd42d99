"""Seeds, logs and what a run is made with."""

from __future__ import annotations

import logging
import os
import platform
import random
import sys
import time

import numpy as np
from pyspark.sql import SparkSession


def seed_everything(seed: int) -> None:
    """The driver's random sources. Operators take no random choices; those that sample (geometric checks) have seeds of their own."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    os.environ["PYTHONHASHSEED"] = str(seed)


def logger(name: str = "lodeframe", folder: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, with folder, to a file named by the UTC time. Handlers of an earlier call go."""
    out = logging.getLogger(name)
    out.setLevel(level)
    out.propagate = False
    for old in list(out.handlers):
        out.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder is not None:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, time.strftime("run_%Y%m%d_%H%M%S.log", time.gmtime())), encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        out.addHandler(handler)
    return out


def runtime_info(spark: SparkSession | None = None) -> dict[str, str | int]:
    """Versions and the machine; with a session also Spark's version, master and cores."""
    out: dict[str, str | int] = {"python": sys.version.split()[0], "platform": platform.platform(), "machine": platform.machine(), "processors": os.cpu_count() or 1, "numpy": np.__version__}
    if spark is not None:
        context = spark.sparkContext
        out |= {"spark": spark.version, "master": context.master, "default_parallelism": context.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}
    return out
