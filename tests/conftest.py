import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("pagemark-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a column function over literal argument rows, in their order."""
    from pyspark.sql import functions as F

    def run(function, rows, types=None):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        width = len(rows[0])
        types = types or ["string"] * width
        names = [f"arg{i}" for i in range(width)]
        schema = "i int, " + ", ".join(f"{n} {t}" for n, t in zip(names, types))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("i", function(*(F.col(n) for n in names)).alias("out"))
        return [r.out for r in sorted(out.collect(), key=lambda r: r.i)]

    return run
