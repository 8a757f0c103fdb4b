"""Shapes of plans."""

import re

from pyspark.sql import functions as F

from tessera.operators import chat as C
from tessera.operators import positions as P


def exchanged(df, column):
    """How often an exchange moves ``column``."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    text = text.split("== Initial Plan ==")[-1]
    found = re.findall(r"\((\d+)\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", text)
    return len({k for k, cols in found if re.search(rf"\b{column}#", cols)})


def test_text_is_dealt_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        turns = spark.range(100).select((F.col("id") % 9).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                        F.concat(F.lit("a <image> b <video> "), F.col("id").cast("string")).alias("flat"))
        grid = spark.range(9).select(F.col("id").alias("conv_id"), F.lit("image").alias("kind"))
        one = C.tag_pieces(turns, "conv_id", "turn", "flat", active=P.sample_tags(grid))
        assert exchanged(one, "flat") == 1
        assert exchanged(C.tag_pieces(turns, "conv_id", "turn", "flat"), "flat") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = sorted((r.conv_id, r.turn, r._piece_no, r.tag, r.tag_index) for r in one.collect())
    want, seen = [], {}
    for i in range(100):
        k = seen.get(i % 9, 0)
        seen[i % 9] = k + 1
        want += [(i % 9, i, 0, "<image>", k), (i % 9, i, 1, None, None)]
    assert rows == sorted(want)
