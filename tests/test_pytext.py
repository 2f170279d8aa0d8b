import random
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.pytext import pystr


def test_doubles_print_as_in_python(spark):
    random.seed(3)
    values = [struct.unpack("<d", struct.pack("<Q", random.getrandbits(64)))[0] for _ in range(100_000)]
    values += [random.uniform(-1e19, 1e19) for _ in range(30_000)] + [2.0**k for k in range(-1074, 1024)]
    values += [float(random.randint(1, 10**18)) for _ in range(10_000)] + [5e-324 * random.randint(1, 10**12) for _ in range(2000)] + [0.0, -0.0, float("inf"), float("-inf")]
    values = [x for x in values if x == x]
    told = spark.createDataFrame(pd.DataFrame({"x": values})).select("x", pystr(F.col("x"), T.DoubleType()).alias("text")).toPandas()
    assert len(told) == len(values) and all(str(x) == text for x, text in zip(told["x"].tolist(), told["text"]))
