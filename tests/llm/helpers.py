"""Plain versions that the operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, texts, **extra):
    """A documents table of texts, with a column whose name clashes with results."""
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


#: Nulls, empty and blank texts, one very long word, a long text, ties and repeats.
ODD = [None, "", " \n\t ", "x" * 40_000, "a b c " * 5_000, "Same text here", "Same text here", "é̀ 中文 😀 \x00", "UPPER lower", "1.2.3.4 a@b.co"]
