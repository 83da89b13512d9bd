"""Small tables that every operator has to survive, and random texts with planted overlaps."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, copy int, bits bigint, n_lines int"


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, names that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight", "en", "a", 1, 0.5, 1, 1, 1),
        (1, "one two three four five six seven eight", "en", "a", 1, 0.5, 1, 1, 1),
        (2, "", "en", "b", 0, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, " \n\t \n", "en", "b", 5, 0.1, 2, 2, 2),
        (5, long, "en", "c", len(long), 0.1, 2, 2, 2),
        (6, long, "en", "c", len(long), 0.1, 2, 2, 2),
        (None, "one two three four five six seven eight", None, "a", 1, None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
        (7, "é\U0001f600 <|im_end|> +1 (555) 555-1234 a@b.co 10.0.0.1", "fr", "", 9, 0.0, 0, 0, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(n=400, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]


def texts(n, seed, words=(5, 160)):
    """Random texts; some are copies, some hold a passage of another one, some have a few words changed."""
    rnd, vocab, made = random.Random(seed), vocabulary(), []
    for _ in range(n):
        kind = rnd.random()
        if made and kind < 0.1:
            made.append(rnd.choice(made))
        elif made and kind < 0.4:
            old = rnd.choice(made).split(" ")
            at = rnd.randrange(len(old))
            mine = [rnd.choice(vocab) for _ in range(rnd.randrange(*words))]
            where = rnd.randrange(len(mine))
            made.append(" ".join(mine[:where] + old[at : at + rnd.randrange(30, 120)] + mine[where:]))
        elif made and kind < 0.6:
            old = rnd.choice(made).split(" ")
            for _ in range(rnd.randrange(1, 4)):
                old[rnd.randrange(len(old))] = rnd.choice(vocab)
            made.append(" ".join(old))
        else:
            made.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(*words))))
    return made
