"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, `row` long, size string, `_kf_text` int, id int"

LONG = " ".join(f"word{i % 700}x{i % 13}" for i in range(60_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank today",
    "The quick brown fox jumps over the lazy dog near the river bank today",
    "  \t\n ",
    "",
    None,
    "one",
    "one two",
    "Größe übermäßig ÉCOLE naïve 你好 世界 🙂 <|endoftext|> café",
    "Same line\nSame line\nSame line\n\nother line\nSame line",
    "under the MIT License. Apache License, Version 2.0 and CC BY-NC 4.0; under the mit license",
    LONG,
    "a b c a b c a b c # * $ % & | < >",
]


def documents(spark, texts=TEXTS, null_ids=True, repeat=True):
    rows = [(i, t, "en" if i % 2 else "fr", [None, "b", "a", "b"][i % 4], 0, 1, 2, "s", 3, 4) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[0], rows[0], rows[-1]]
    if null_ids:
        rows += [(None, texts[0], None, None, None, None, None, None, None, None), (None, None, None, "a", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
