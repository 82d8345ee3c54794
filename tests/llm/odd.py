"""Null, empty and very long texts, ties, repeated rows and a null id."""

LONG = " ".join(f"word{i % 5000}" for i in range(40_000))
ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, "a"), (5, "a b"), (5, "a b"), (6, "A  B"), (7, LONG), (8, LONG + " end"),
       (None, "a b c d e f"), (9, "a b c d e f"), (10, "... !!! 123"), (11, "\u00e9t\u00e9 stra\u00dfe \u0416\u0438\u0437\u043d\u044c")]

