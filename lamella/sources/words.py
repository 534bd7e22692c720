"""Word lists, one word a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_words(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(word): the lines of a file without empty ones; with ``upper``, upper-case copies as well. Repeats go."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).where("word != ''")
    if upper:
        words = words.union(words.select(F.upper("word").alias("word")))
    return words.distinct()


def outliers(words: DataFrame) -> DataFrame:
    """(word): texts that are made of words and are none of them: mirrored, doubled and framed ones."""
    w, r = F.col("word"), F.reverse("word")
    made = words.select(F.explode(F.array(F.concat(w, r), F.concat(w, w), F.concat(r, w, r), F.concat(w, F.lit("~")))).alias("word")).distinct()
    return made.join(words, "word", "left_anti")
