"""Documents with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, row long, key string, size int, piece string, component_id long, n long"

WORDS = ["the", "of", "and", "Haus", "maison", "ciudad", "über", "naïve", "don't", "x,", "y.", "A1", "漢字", "z z"]


def documents() -> list[tuple]:
    draw = random.Random(7)
    text = lambda n: " ".join(draw.choice(WORDS) + str(draw.randrange(60)) for _ in range(n))
    shared, long = text(80), text(6000)
    rows = [
        (1, None), (2, ""), (3, "   "), (4, "a"), (5, "two  words"), (6, "tabs\tand\nlines \r\n end "), (7, text(300)), (8, long), (9, long + " more"),
        (10, text(30) + " " + shared + " " + text(30)), (11, shared + " tail"), (12, text(5) + " " + shared), (13, "<|endoftext|> in <|endoftext|>text"), (14, "emoji 🎉🎉 and   wide \x85 spaces"),
        (15, "x" * 3000), (16, "!!! ??? ..."), (17, "12345 67890"), (None, "no id"), (None, "no id"), (None, None), (20, "same row"), (20, "same row"), (21, "same row"), (22, "Same  row"),
        *[(100 + k, "hot copy of a text that is everywhere") for k in range(40)],
        *[(200 + k, shared + f" near {k % 3}") for k in range(12)],
        *[(300 + k, text(60)) for k in range(30)],
    ]
    return [(i, t, [None, "en", "de"][k % 3], [None, "a", "b", "c", "é"][k % 5], 5, "clash", 7, "p", 1, 2) for k, (i, t) in enumerate(rows)]
