"""Small tables with the odd cases that every operator must take."""

import random


def prose(rnd, n):
    return " ".join(rnd.choice(("the", "of", "river", "stone", "walks", "blue", "idea", "because", "seven", "Garden", "moon.", "light,")) + rnd.choice(("", "", "s", "ly", "ed")) for _ in range(n))


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    made = [prose(rnd, rnd.randrange(1, 120)) for _ in range(n)]
    made += [made[3], made[3], made[5] + " tail", "", None, " \n\t ", "!!!", "!!!", "x", "a b c d", "a b c d", "é ñ 漢字 😀 <|im_end|> </s>", "word " * 3000, "y" * 70_000, made[7].replace("the", "The"), "\n".join([made[2]] * 4)]
    return made


def documents(spark, rows=None):
    """Documents with repeated rows, null sources and columns named like results."""
    made = rows if rows is not None else [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts())]
    made = [(*r, "clash", -1, False) for r in made]
    return spark.createDataFrame(made + made[:2], "doc_id long, text string, lang string, source string, n_chars long, key string, n_tokens int, kept boolean")


EMPTY: list = []
