"""Tables that every operator has to stand."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river bends near an old mill where seven millers once ground barley for the whole valley".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)] + str((seed + i) % 11) for i in range(n))


def odd_rows() -> list[tuple]:
    """Null and empty texts, ties, repeated rows, a very long text, white space, rare characters."""
    long = "\n".join(prose(s, 40) for s in range(500))
    rows = [
        (0, None, None, "a", None), (1, "", "en", "a", 0), (2, " \t\n ", "en", None, 4), (3, "One two three.", "en", "a", 14), (4, "one  two\nthree.", "en", "a", 14),
        (5, "One two three.", None, "a", 14), (5, "One two three.", None, "a", 14), (6, long, "en", "a", len(long)), (7, long + " tail", "en", "b", len(long) + 5),
        (8, "été ß İ 🙂 漢字 12½ <|endoftext|> don't".encode("utf-16", "surrogatepass").decode("utf-16"), "fr", "b", 30), (9, "12 34 !!", "en", "b", 8), (10, "\n".join(["same line of ten words is here again and again"] * 3), "en", "b", 100),
    ]
    return rows + [(100 + i, prose(i % 6, 30 + i % 4), "en", "src", 100) for i in range(40)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """With extra columns under the names that an operator uses or returns."""
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
