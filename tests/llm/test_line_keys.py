"""Keys of a line's tokens."""

from pyspark.sql import functions as F

from isolens.llm import line_dedup


def test_keys_are_sorted_as_plain_numbers(spark):
    rows = spark.createDataFrame([("b a  b c",), ("",), ("\t",)], "line string").select(line_dedup._codes(F.col("line")).alias("codes"))
    scale = 7 << line_dedup.CODE_BITS
    df = rows.withColumn("rarity", F.array_repeat(F.lit(scale), line_dedup.BUCKETS)).select("codes", line_dedup._ordered("codes", "rarity").alias("set"))
    assert not df.schema["set"].dataType.containsNull  # else Spark sorts objects
    low = (1 << line_dedup.CODE_BITS) - 1
    got = df.collect()
    assert [len(r.set) for r in got] == [3, 0, 0]
    assert all(r.set == sorted(scale | c & low for c in r.codes) for r in got)
