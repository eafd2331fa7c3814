"""Small tables with the awkward cases that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, start int"

SECRET = "x api_key = 'AbCdEf123456' y"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),  # a copy
    (2, "one two three four five six seven", "en", "a", 33),  # a repeated row
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "en", "b", 4),
    (6, "Mail ana.b@mail.example.org or call +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.255 now", "de", "a", 100),
    (7, SECRET, "fr", None, 27),
    (8, "é ü ñ 中文 " * 20, "zh", "c", 180),
    (9, "word " * 30_000, "en", "a", 150_000),  # very long
    (10, "x" * 100_000, "en", "c", 100_000),  # one very long word
    (None, "no id here", "en", "a", 10),
    (0, None, None, None, None),
]


def frame(spark, rows=None):
    """documents with extra columns whose names clash with those that operators make."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, 7, "k", 1) for r in rows], SCHEMA)
