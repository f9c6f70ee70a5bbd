"""Rows that every text operator must take."""

#: Nulls, empty and blank texts, repeated rows and ids, one very long text, odd characters.
AWKWARD = [
    (None, None),
    (None, "a b c d e f g"),
    (1, None),
    (1, ""),
    (2, "  \n\t "),
    (3, "one"),
    (4, "one two three four"),
    (5, "same text in two rows of one id here\nand a second line"),
    (5, "same text in two rows of one id here\nand a second line"),
    (6, "same text in two rows of one id here\nand a second line"),
    (7, "line\n" * 50),
    (8, " ".join(f"w{i % 977}" for i in range(60_000))),
    (9, "é ß   x\x1cy <|endoftext|> \U0001f600 \x00 z"),
    (9, "another text under the same id"),
]
