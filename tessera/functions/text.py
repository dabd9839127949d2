"""Normalising and cutting text into terms, as Catalyst expressions."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM = "áàâäãåāăąçćčďéèêëēėęěğíìîïīįıłñńňóòôöõøōőŕřśšşťúùûüūůűųýÿźžż’"
_TO = "aaaaaaaaacccdeeeeeeeegiiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz'"
WORD = r'(?U)(\w+|")'


def folded(text: Column, case: bool = True, accent: bool = True) -> Column:
    if case:
        text = F.lower(text)
    if accent:
        text = F.translate(text, _FROM + ("" if case else _FROM.upper()[: len(_FROM) - 1]), _TO + ("" if case else _TO.upper()[: len(_TO) - 1]))
        text = F.replace(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return text


@cache
def _capitals() -> tuple[str, str]:
    """All letters that have a capital of one character, and these capitals."""
    found = {}
    for i in range(128, sys.maxunicode + 1):
        x = chr(i)
        capital = next((y for y in (x.upper(), x.title()) if len(y) == 1), x)
        if capital != x:
            found[x] = capital
    found |= {x: x.upper() for x in "abcdefghijklmnopqrstuvwxyz"} | {"ß": "ẞ"}
    return "".join(found), "".join(found.values())


def capitals(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it: of ß it is ẞ, and a letter without a capital of one character stays. Spark's upper makes SS of ß."""
    return F.translate(text, *_capitals())


def terms(text: Column, case: bool = True, accent: bool = True) -> Column:
    """Words, without underscores; a quotation mark is a term."""
    return F.regexp_extract_all(F.replace(folded(F.coalesce(text, F.lit("")), case, accent), F.lit("_"), F.lit("")), F.lit(WORD), F.lit(1))
