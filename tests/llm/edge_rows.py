"""Rows that every operator must handle."""

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
#: ids and texts: null, empty and blank texts, ties, repeated rows, null ids, a very long text.
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b\tc"), (5, "a b  c"), (6, "a b c"), (6, "a b c"), (6, "other text"),
    (7, "A B C"), (8, LONG), (9, LONG), (10, LONG + " end"), (11, "one line\nsecond line\nthird line\nfourth"),
    (12, "x\none line\nsecond line\nthird line\ny"), (None, "a b c"), (None, "only null id"), (None, None),
    (13, "été naïve 日本語 \U0001f600 text"), (14, "l\nl\nl\nl\nl"), (-5, "a b c "),
]
EDGE_ROWS = [(i, t, ["s", None, "z", ""][k % 4]) for k, (i, t) in enumerate(EDGE)]
