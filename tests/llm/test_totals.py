"""Running totals of long arrays."""

import numpy as np
from pyspark.sql import functions as F

from quillet.llm import chat


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 99, n).tolist() for n in (0, 1, 127, 128, 129, 1000, 5000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, n array<int>").select("k", chat.running_totals("n").alias("t"))
    got = {r["k"]: r["t"] for r in df.collect()}
    assert all(got[k] == [0, *np.cumsum(x).tolist()][: len(x)] for k, x in enumerate(lists))
    assert df.where(F.size("t") > 0).count() == 6
