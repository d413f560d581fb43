"""Small tables with the awkward rows that every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, rate double"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(texts, lang="en"):
    return [(i, t, lang, "s", None if t is None else len(t), "clash", 0.5) for i, t in texts]


def awkward():
    long = words(60_000, 1)
    near = words(80, 2)
    return rows(
        [
            (1, None), (2, ""), (3, "   \n\t \n"), (4, "one"), (5, near), (6, near), (6, near), (7, near + " more words here"),
            (8, "x" * 200_000), (9, long), (10, long + " tail"), (None, near), (None, None), (11, "é ü ñ 中文 🙂\r\nline"), (12, "Same\nSame\nSame"),
        ]
    )
