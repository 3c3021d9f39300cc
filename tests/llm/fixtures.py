"""Documents with everything that texts may be: null, empty, long, repeated, tied, with clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, kept string"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    words = ["the", "of", "ab", "Über", "été", "naïve", "x1", "日本", "42", "don't", "a,b", "end."] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 3, 7, 25, 60, 150)))) for _ in range(n)]
    passage = " ".join(r.choice(words) for _ in range(70))
    out: list[str | None] = list(base)
    for k in range(0, n, 6):
        out[k] = f"{base[k]} {passage}\n{base[(k + 1) % n]}"
    for k in range(3, n, 10):  # near copies
        tokens = base[5].split() or ["z"]
        tokens[k % len(tokens)] = "changed"
        out[k] = " ".join(tokens) if k % 20 else base[9]
    out[1] = None
    out[2] = ""
    out[4] = "  \t\n "
    out[7] = out[8] = out[9]
    out[10] = " ".join(r.choice(words) for _ in range(20_000))  # very long
    out[11] = "w" * 5000
    out[12] = " ".join(["again"] * 100)
    out[13] = "tail " + " ".join(["again"] * 30)
    return out


def documents(spark, seed: int = 1, n: int = 60):
    rows = [(3 * k + 1, t, "en" if k % 3 else None, None if k % 7 == 0 else "hot" if k % 2 else f"s{k % 5}", None if t is None else len(t), 0.5, "x", "y") for k, t in enumerate(texts(seed, n))]
    rows.append(rows[20])  # a repeated row
    rows.append((None, "a row without an id of eight words here", None, "s1", 3, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
