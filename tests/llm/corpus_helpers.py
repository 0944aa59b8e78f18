"""Small tables for the corpus operators, with the awkward rows among them."""

import random

SYLLABLES = "ta ro mi ne lo ka su pe di vo han ber lin gor mes tul".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows, more=""):
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{more}")


def row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text))


def awkward(rng):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text."""
    long = words(rng, 60_000)
    return [row(1, None), row(2, ""), row(3, " \n\t "), row(4, long), row(4, long), row(None, "no id " + words(rng, 20)), row(None, None, None), row(5, words(rng, 30), None), row(6, "é ü ß 漢字   x"), row(7, "tie"), row(8, "tie")]
