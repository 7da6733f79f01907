"""Awkward documents: nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""

LONG = ("The quick brown fox. " * 9000 + "x" * 40_000 + " +1 (212) 555-0188 ") + "end"
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "naïve café \U0001f600 привет 你好 \x1c\x85 mail me: a.b@example.org, 10.0.0.1\nline\nline\nline"),
    (None, "no id here at all"),
    (None, None),
    (8, "a b"),
    (9, "$$$ ### *** " * 30),
]
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, length long, cell int, rank int, score double, key string, fp long, word string, "
    "n_words long, kept boolean, payload binary, ids array<long>, list int, size long, shard int, y int, piece int"
)


def documents(spark, rows=None):
    extra = ("en", "s", 1, 7, 7, 7, 0.5, "k", 3, "w", 1, False, b"p", [1], 2, 9, 4, 1, 3)
    return spark.createDataFrame([(*r, *extra) for r in (TEXTS if rows is None else rows)], COLUMNS)


def clean_text(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
