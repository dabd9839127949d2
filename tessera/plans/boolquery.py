"""Boolean text queries. Operators have no precedence: the first one outside parentheses splits, so they bind to the right."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, ANDNOT
    left: Term | Op
    right: Term | Op


Node = Term | Op
_SPLIT = re.compile(r"\s+(AND\s+NOT|ANDNOT|AND|OR)\s+", re.IGNORECASE)


def _outside(text: str, at: int) -> bool:
    before = text[:at]
    return before.count("(") == before.count(")") and before.count('"') % 2 == 0


def _wrapped(text: str) -> bool:
    if not (text.startswith("(") and text.endswith(")")):
        return False
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and i < len(text) - 1:
            return False
    return True


def parse(text: str) -> Node:
    text = text.strip()
    while _wrapped(text):
        text = text[1:-1].strip()
    if not text or text.count("(") != text.count(")") or text.count('"') % 2:
        raise ValueError("malformed query")
    at = 0
    while m := _SPLIT.search(text, at):
        if _outside(text, m.start()):
            return Op(re.sub(r"\s+", "", m[1]).upper(), parse(text[: m.start()]), parse(text[m.end() :]))
        at = m.start() + 1
    if "(" in text:
        raise ValueError("malformed query")
    return Term(text.strip('"'))


def positive(node: Node) -> list[str]:
    """Terms that are not under a NOT."""
    if isinstance(node, Term):
        return [node.text]
    return positive(node.left) + ([] if node.kind == "ANDNOT" else positive(node.right))
