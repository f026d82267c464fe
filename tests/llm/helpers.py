"""Fixtures of awkward rows: nulls, empty and very long texts, repeated rows, extra columns with clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, name string, id string, score string"


def awkward(spark, rows):
    """``documents`` with further columns named like results and intermediate columns."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "w") for i, t in rows], DOCS)


def rows_of(df, *columns):
    key = lambda row: tuple((v is not None, v) for v in row)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
