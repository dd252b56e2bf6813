"""Documents with everything that operators must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, ids string, g int, key string, p int, kind string, target string, component_id string, media string, a string, _text string"
EXTRA = (1, "x", "y", 2, "k", 3, "z", "t", "c", "m", "a", "b")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def documents() -> list[tuple]:
    rng = random.Random(5)
    texts = [sentence(rng, 12) + "\n" + sentence(rng, 30) for _ in range(24)]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    base = sentence(rng, 60)
    rows += [(100 + k, base.replace("a", "o", k % 3), "en", "s0", None) for k in range(8)]  # near copies
    rows += [(200, "", "en", "s1", 0), (201, None, None, None, None), (202, " \t\r\n\x0b\x0c ", "de", "s1", 7), (203, "one two", "en", "s2", 7), (204, "one  TWO ", "de", "s2", 9), (205, "12 34 !! --", "en", "s3", 11)]
    rows += [(None, texts[0], "en", "s0", 5), (7, texts[7], "en", "s3", 9), (7, texts[7], "en", "s3", 9), (8, "another text with the id eight and enough words", "en", "s3", 3)]
    rows += [(300, sentence(rng, 9000), "en", "s1", 1), (301, "x" * 40_000, "en", "s1", 1), (302, "漢字🙂 naïve ﬁ\u00a0nbsp\u2028line " * 9, "en", "s2", 1)]
    return [r + EXTRA for r in rows]
