"""Small tables with everything that may come: NULLs, blanks, long texts, repeats, odd columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_number long, _h long, digest string"


def odd_documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß中XYZ019") for _ in range(rng.randint(1, 9)))
    base = " ".join(word() for _ in range(80))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 160))), "en", "a") for i in range(40)]
    rows += [(100 + i, base, "en", "a") for i in range(12)]
    rows += [(120 + i, base.replace(" ", "\n", i), "en", "b") for i in range(4)]
    rows += [(200, None, "en", "a"), (201, "", "de", "b"), (202, " \n\t ", None, None), (None, "no id here", "en", "b")]
    rows += [(203, "one", "en", "c"), (204, "x y", None, "c"), (205, "long word " * 4000, "en", "é")]
    rows += [(206, "same row", "en", "a")] * 3 + [(207, "first", "en", "a"), (207, "second", "en", "a")]
    return [(*r, 0, 7, 8, "d") for r in rows]


def frames(spark):
    """The odd table, and an empty one with the same columns."""
    return spark.createDataFrame(odd_documents(), DOCS), spark.createDataFrame([], DOCS)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
