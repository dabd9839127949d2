"""Plain Python versions to hold the operators against, and fixtures."""

from __future__ import annotations

import random

from tessera.llm import textscan

WORDS = "alpha beta gamma delta river stone cloud tree light house paper glass metal green brown small large open water fire wind earth north south".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def word_hashes(text: str | None) -> list[int]:
    return textscan.hash_of(text or "")


def gram_set(text: str | None, n: int) -> set[tuple[int, ...]]:
    h = word_hashes(text)
    if not h:
        return set()
    return {tuple(h[i : i + n]) for i in range(max(1, len(h) - n + 1))}


def docs_frame(spark, rows, extra=False):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", part int, mark string, hub long, u double" if extra else "")
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) + ((1, "x", 2, 0.5) if extra else ()) for i, t in rows], schema)
