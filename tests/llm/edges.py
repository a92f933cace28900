"""A small table of hard rows that every text operator must take."""

LONG = " ".join(f"word{k % 97}x{k % 89}" for k in range(20_000))
ROWS = [
    (1, "The cat sat on the mat, and the dog of the house went to it. " * 12, "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n ", "fr"),
    (5, "mot", "fr"),
    (6, LONG, "de"),
    (7, "Ünï©ødé 🙂 \x00 \x1c text", None),
    (8, "same text twice " * 30, "en"),
    (8, "same text twice " * 30, "en"),
    (9, "same text twice " * 30, "es"),
    (None, "a row without an id but with some words in it", "en"),
]


def table(spark, rows=ROWS):
    """With extra columns whose names clash with what operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("doc_id", "text", "lang", "'x' AS _text", "1 AS _id", "2 AS _h", "'y' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "0 AS score")


def empty(spark):
    return table(spark).limit(0)
