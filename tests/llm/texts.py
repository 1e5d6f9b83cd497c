"""Texts for the tests of the text operators."""

import random

WORDS = "the of and tion er ing größe élan señor 日本 x1 don't it's | # 2024 ... émi x".split(" ")


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_texts():
    """Nulls, empty texts, white space, repeats, ties, many scripts and a very long text."""
    rng = random.Random(5)
    base = passage(1, 120)
    texts = [None, "", " ", "\n\n \t", "a", "a a", base, base, base + " end", "start " + base, "x" * 3000, "ab" * 900]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(30)]
    texts += ["\n".join([passage(3, 12)] * 5 + [passage(i, 9)]) for i in range(3)]
    texts += [passage(9, 9000), "\x1c\x85  a　b \u0000 c", "🙂🙂 family 👨‍👩‍👧\r\n\r\n  end  "]
    return texts
