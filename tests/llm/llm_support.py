"""Documents of the operators' tests: odd ones, and the folder of the given tables."""

from __future__ import annotations

import os

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, size string, key string, found string, target string, n string"
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark, rows):
    """Rows (doc_id, text, lang, source), with more columns whose names the operators use inside."""
    full = [(i, t, l, s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t, l, s in rows]
    return spark.createDataFrame(full, DOCUMENTS)


LONG = "word " * 3000 + "1" * 5000 + " " + "a" * 20000 + " " + "a.b" * 3000 + " +" + "1 " * 3000
ODD = [
    (1, "Hello there, this is a text.", "en", "b"),
    (1, "Hello there, this is a text.", "en", "b"),
    (2, "hello THERE, this is a text.", "en", None),
    (3, None, "en", "a"),
    (4, "", None, "a"),
    (5, "   \n\t ", "de", None),
    (6, LONG, "de", "a"),
    (7, LONG, None, "c"),
    (None, "No id but words in it", "en", "c"),
    (8, "É à ß 12 !!", "fr", "c"),
]
