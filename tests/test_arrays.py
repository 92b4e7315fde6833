"""Rounding of values that become 0."""

import math

from pyspark.sql import functions as F

from rankloom.functions import arrays as A
from rankloom.plans import catalog


def test_zeros_keep_their_sign(spark, tmp_path):
    values = [-1e-7, 1e-7, -0.0, 0.0, -5e-7, 1.5e-6, -0.25, float("nan")]
    got = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", lambda v: A.rounded(v, 6)).alias("v")).first().v
    assert [str(x) for x in got] == ["-0.0", "0.0", "-0.0", "0.0", "-1e-06", "2e-06", "-0.25", "nan"]
    spark.createDataFrame([(1, [-1e-7] * 64, 0)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, column in (("binarised", "v"), ("padded", "padded"), ("k_max", "top")):
        first = catalog.queries()[name](spark, str(tmp_path)).first()[column][0]
        assert first == 0 and math.copysign(1, first) == -1, name
