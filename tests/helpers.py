from pyspark.sql import functions as F


def values(spark, cases, build, schema):
    """Results of one expression over literal rows, in order."""
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "_i int, " + schema)
    return [r["x"] for r in df.select("_i", build(F.col).alias("x")).orderBy("_i").collect()]
