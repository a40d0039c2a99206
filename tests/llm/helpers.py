from __future__ import annotations

from pyspark.sql import types as T

LANGS = {"en": "the and of ing tion thing hand other ", "de": "der die und ich ein nicht auch schön ", "fr": "le la les eau que été où deux "}


def documents(spark, rows, extra=""):
    """rows: (doc_id, text[, lang, source]); with a column that clashes, if asked for."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    df = spark.createDataFrame(full, schema)
    for name in extra.split():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("mine"))
    return df


def odd_texts():
    """Null, empty, blank, very long, non-Latin, with repeated rows among them."""
    long = "word " * 60_000 + "end"
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "Привет мир, 你好 世界"), (6, "a b c"), (6, "a b c"), (None, "no id at all"), (7, "A B c"), (8, "é ᾚ \U0001f600 x" * 3)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
