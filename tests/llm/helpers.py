"""Small tables and plain Python versions that the tests hold the operators against."""

import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: A text longer than a chunk of the vectorised helpers, with words of four alphabets.
LONG = "Grün et façade naïve 東京 word " * 50_000


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def edge_rows():
    """(doc_id, text, n_shingles): null ids and texts, empty, blank and long texts, repeated rows, a clashing column."""
    return [
        (1, "The Quick brown fox, jumps over the lazy dog. " * 12, 7),
        (2, None, 7),
        (None, "a text without an id, said once", None),
        (3, "", 7),
        (4, " \t\n\x0b\x0c\r ", 7),
        (5, "same words here twice", 7),
        (5, "same words here twice", 7),
        (6, LONG, 7),
        (7, "İstanbul ſ K \x1c\x85 x <|endoftext|> é", 7),
        (None, None, None),
    ]


def edge_docs(spark):
    """With columns named as the operators' own results."""
    return spark.createDataFrame(edge_rows(), "doc_id long, text string, n_shingles long").selectExpr("*", "text AS findings", "1 AS score", "2 AS ids", "3 AS block", "4 AS class_id", "5 AS token")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df, *names):
    """Sorted rows of some columns, nulls first."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: [(x is not None, x) for x in t])
