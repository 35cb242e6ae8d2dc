"""Helpers of the tests in this folder."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words_of(text):
    """Words are what lies between ASCII white space."""
    return WORD.findall(text or "")


def documents(spark, rows, parts=3):
    """Rows as a table with further columns, some named like the operators' own."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), -1, b"k") for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, _id int, kept binary").repartition(parts)
