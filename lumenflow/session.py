"""Sessions for tests, benchmarks and notebooks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, name: str = "lumenflow") -> SparkSession:
    """A local session with the settings that every query here assumes: UTC and adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once for each application, wherever they run."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.gettempdir(), f"lumenflow-{sc.applicationId}.zip")
    if path not in _shipped:
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("lumenflow", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _shipped.add(path)
    return spark


_shipped: set[str] = set()
