"""Rows with every oddity."""

import random

CLASH = ("score", "_row", "size", "key", "fp", "h", "kept", "group", "x1", "rest", "word", "_text", "n_words", "source_size")


def odd_rows(n=60, seed=4):
    """Rows (doc_id, text, lang, source): nulls, empty and long texts, ties, repeats and near copies."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(80)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, hot = text(70), text(90)
    rows = [(None, None, None, None), (1, None, "en", None), (2, "", "en", "s1"), (3, "   \n\t ", "en", "s1"), (None, hot, "en", "s1"), (5, hot, "en", "s1"), (5, hot, "en", "s1"), (4, hot.replace(" ", "\n", 3), "de", "s2"), (6, hot + " tail", "en", "s1"), (7, "Ünï ÇÖDÉ <|endoftext|> 漢字 it's 12 ▁ a  b ", "fr", "s2"), (8, "x" * 5000, "en", "s3"), (9, text(6000), "en", "s1")]
    for i in range(10, n):
        body = text(r.randint(1, 120))
        rows.append((i, f"{body} {passage} {body}" if i % 4 == 0 else body, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s2", "s3", None])))
    rows.append((100, rows[20][1], "en", "s1"))
    return rows
