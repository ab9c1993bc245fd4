"""Small inputs that the operator tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, keep_id string, digest string"


def prose(seed, n, words=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank, short and long texts, exact and near copies, repeated rows."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(2, 50)
    texts = [
        (1, base), (2, base.replace(" ", "\t \n", 5)), (3, near), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one two"),
        (9, "One  Two"), (10, prose(3, 40) + " " + passage + " " + prose(4, 30)), (11, passage + "\n" + prose(5, 20)), (12, "x " * 300),
        (13, prose(6, 6000, 5000)), (14, "é ß 中文 <|endoftext|>   end . don't!!\r\n\x0bé"), (15, "a" * 5000), (15, "a" * 5000),
        (None, base), (None, None), (16, "12 34 !!"), (17, passage), (18, near + " tail"),
        (19, "Same line\nother\nSame line\n\nother \n same five words here now same five words here now ###"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src0", None if k % 3 == 0 else 7, 99, 1, "clash", "clash")
            for k, (i, t) in enumerate(texts)]
