"""Rows that the tests of this folder share."""

#: Null, empty and white texts, copies, repeated rows, ids that are null or repeat, one long text.
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, "b"),
    (4, "one two three four five six seven eight", "en", None),
    (5, "one two three four five six seven eight", "en", "a"),
    (5, "one two three four five six seven eight", "en", "a"),
    (6, "One  TWO three four five six seven eight", "en", "b"),
    (7, "word", "en", "b"),
    (8, "日本語 😀 é x", "xx", "c"),
    (None, "a row without an id", "en", "c"),
    (9, "line one\nline two\nline three\n" * 3, "en", "c"),
    (10, "long text " * 20_000, "en", "a"),
]
