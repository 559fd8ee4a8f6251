import pytest
from pyspark.sql import functions as F


class Cases:
    """Documents with nulls, empty and long texts, ties, repeats and clashing columns."""

    SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
    EXTRA = ("row", "_id", "_key", "_tie", "_ranges", "_done", "key", "kept", "n", "label", "part", "removed", "rule")

    def __init__(self, spark):
        self.spark = spark
        words = [f"w{i % 97}x{i}" for i in range(30_000)]
        self.long = " ".join(words)
        sentence = "The {0} fox of number {0} jumps over the lazy dog of number {0} again. "
        self.passage = "".join(sentence.format(i) for i in range(5))
        self.rows = [
            (1, "Plain words in a row. They end here.", "en", "a", 36),
            (2, None, "en", None, None),
            (3, "", None, "a", 0),
            (4, " \n\t ", "en", "a", 4),
            (5, self.long, "en", "a", None),
            (6, self.long, "de", "b", 1),
            (7, "Plain words in a row.\nThey end here.", "en", "a", 36),
            (7, "Plain words in a row.\nThey end here.", "en", "a", 36),
            (None, "Plain  words in a row. They end here.", "en", "a", 37),
            (8, "Own start. " + self.passage + "Own end.", "en", "a", 1),
            (9, "Another start of its own. " + self.passage + "Another end.", "en", "a", 1),
            (9, "A second text under the number nine, all by itself.", "en", "a", 1),
            (10, self.long.replace("w5x5 ", "changed ", 1), "en", "a", 1),
            (11, "日本語のテキスト 🙂 and  two spaces", "ja", "a", 1),
        ]

    def docs(self, rows=None):
        df = self.spark.createDataFrame(self.rows if rows is None else rows, self.SCHEMA)
        return df.select("*", *(F.lit("x").alias(name) for name in self.EXTRA)).repartition(3)

    def empty(self):
        return self.docs([])


@pytest.fixture(scope="session")
def cases(spark):
    return Cases(spark)
