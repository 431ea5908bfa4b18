"""Plain versions of the rules, for comparison."""

import re

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def word_list(text):
    return WORD.findall(lower(text)) if text else []


def docs(spark, rows, extra=True):
    """A documents table; ``extra`` adds columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for c in ("start", "h", "n", "key", "ids", "label"):
            df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return docs(spark, [])
