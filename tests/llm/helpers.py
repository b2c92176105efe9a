"""Edge rows and plain-Python forms that the tests of the operators share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string"


def doc(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), 0.0, "clash")


PROSE = "the cat sat on the mat and looked at it for a while in the sun as one does by day"
EDGES = [
    doc(1, None),
    doc(2, ""),
    doc(3, " \n\t "),
    doc(4, PROSE),
    doc(4, PROSE),
    doc(5, PROSE.upper()),
    doc(6, "é" * 3 + " ß 汉字 😀 <s>[INST]", None),
    doc(7, "word " * 5000, "long"),
    doc(8, "x" * 50_000, "long"),
    doc(9, "\n".join(f"line {i} of this text has the words of line {i % 7}" for i in range(200)), "long"),
    doc(None, "no id here but the words of a text are in it", None),
    doc(10, "a b", ""),
]


def frame(spark, rows=EDGES, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def collect(df, *key):
    return sorted((tuple(r) for r in df.select(*key).collect()), key=repr)
