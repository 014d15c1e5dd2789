from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # columns whose names the operators use inside
                     T.StructField("score", T.DoubleType()), T.StructField("size", T.LongType()),
                     T.StructField("key", T.StringType()), T.StructField("id", T.LongType()),
                     T.StructField("n", T.LongType()), T.StructField("target", T.DoubleType()),
                     T.StructField("_spans", T.StringType()), T.StructField("rep", T.LongType())])

LABELS = "doc_id long, quality int, toxic int"


def doc(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text), 0.5, 7, "k", 1, 2, 3.0, "s", 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)
