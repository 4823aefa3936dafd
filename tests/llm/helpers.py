"""Small documents for the tests: plain ones, and all the odd cases in one table."""

import random

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu") for b in ("ba", "den", "fi", "gor", "lan", "mi", "per", "ros", "tu", "wek")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, ids string, id long, component string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        line = [r.choice(WORDS) for _ in range(r.randint(8, 25))]
        out += [line[0].capitalize(), *line[1:-1], line[-1] + "."]
        out[-1] += "\n" if r.random() < 0.3 else ""
    return " ".join(out[:n]).replace("\n ", "\n")


def frame(spark, rows):
    """Documents from (doc_id, text), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s1", len(t or ""), 0.5, "r", "i", 7, "c") for i, t in rows], SCHEMA)


def edited(text: str, every: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def odd_rows():
    """Null, empty and blank texts, one word, one very long text, repeated rows, ties, no id."""
    base = prose(1, 120)
    return [
        (0, None), (1, ""), (2, " \t\n"), (3, "word"), (4, base), (5, base), (5, base), (6, prose(2, 20_000)), (7, base.upper()), (8, "ä" * 3000), (9, edited(base, 40, 3)),
        (10, prose(4, 80)), (None, prose(4, 80)), (None, None),
    ]
