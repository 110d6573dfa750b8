"""Rows that every document operator must take."""

#: Texts that every document operator must take: null, empty, blanks, no words, ties, copies, non-ASCII, very long.
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, "Grüße an alle, schöne Überraschung überall", "de", "b"),
    (5, "Grüße an alle, schöne Überraschung überall", "de", "b"),
    (5, "Grüße an alle, schöne Überraschung überall", "de", "b"),
    (None, "a row without any id at all", "en", "a"),
    (6, LONG, "en", "b"),
    (7, "... 123 !!!", "en", None),
    (8, "x y z \U0001f600 end", "fr", "c"),
]


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
