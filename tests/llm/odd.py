"""Rows that every operator on documents has to take: nulls, empty and very long texts,
repeated rows and ids, and extra columns whose names the operators might use themselves."""

EXTRA = ("key", "row", "size", "block", "score", "held", "train", "spans", "base", "part", "bucket")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def texts():
    words = [f"w{i % 37}x{i % 11}" for i in range(400)]
    base = " ".join(words)
    return [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "a b c d"), (5, base), (6, base), (7, base + " tail"),
        (8, "x" * 60_000), (9, "word " * 20_000), (5, base), (5, "another text under the same id"), (None, base), (None, None),
        (10, "Émigré ÀÉ mail me: jo.e@ex-ample.co.uk or 10.0.0.255, 4111 1111 1111 1111 +49 (30) 123-4567."),
        (11, "\x00\x01 😀😀 <|endoftext|>   end"), (12, "a\n\n\nb\n"),
    ]


def docs(spark):
    rows = [(i, t, "en", None if n % 4 == 0 else f"s{n % 3}", len(t or ""), *("x" * len(EXTRA))) for n, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, column):
    other = "toxic" if column == "quality" else "quality"
    rows = [(i, i % 2, None) for i in range(40)] + [(1, None, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, f"doc_id bigint, {column} int, {other} int")
