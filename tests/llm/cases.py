"""Odd documents that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, n_lines int, struck int, text_class string, score string, __values int, copies int"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank while seven grey geese fly south for winter days"


def rows():
    def row(doc_id, text, lang="en", source="s0"):
        return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, "y", "z", 3, 4)

    return [
        row(1, PROSE), row(2, PROSE), row(3, PROSE + " again"), row(4, None), row(5, ""), row(6, " \n\t\n"), row(7, LONG), row(8, "one"), row(9, "one", None, None),
        row(10, "naïve — 東京 \U0001f600 text", "xx", "s1"), row(10, "naïve — 東京 \U0001f600 text", "xx", "s1"), row(None, "an id is missing here, five words"), row(11, PROSE.upper(), "en", None),
    ]


def documents(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
