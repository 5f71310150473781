import math
import random

from pyspark.sql import functions as F

from vitrine.functions.rounding import exact_round, whole
from vitrine.operators.similarity import exact_round4

import numpy as np


def test_exact_round_is_python_round(spark):
    rng = random.Random(5)
    values = [rng.uniform(-120, 120) for _ in range(3000)] + [i / 20 for i in range(-400, 2100)] + [i / 16 for i in range(400)]
    values += [21.95, 0.35, 2.5, 17.65, 0.00005, 0.12345, 1e-9, -2.5, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", *[exact_round(F.col("v"), n).alias(f"r{n}") for n in (1, 2, 4)], whole(F.col("v")).alias("w")).collect()
    for r in rows:
        for n in (1, 2, 4):
            assert r[f"r{n}"] == round(r["v"], n), (r["v"], n)
        assert r["w"] == int(round(r["v"]))


def test_numpy_form_agrees():
    values = np.random.default_rng(1).random(20000)
    got = exact_round4(values)
    assert all(g == round(float(v), 4) for g, v in zip(got, values))
    assert not math.isnan(got.sum())
