"""Splitting texts by the public tokenizers' patterns, fast where Python's own engine agrees.

The patterns speak of letters (\\p{L}), numbers (\\p{N}) and white space.  Python's ``re`` has no
such classes, yet on almost all texts ``[^\\W\\d_]``, ``\\d`` and ``\\s`` mean the same and run several
times faster than the ``regex`` library.  The characters on which they differ are found by rule
(numbers that are no decimal digits, separators only Python takes for blanks, unassigned ones); a
text that holds any of them goes to ``regex``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import regex

FAST = {r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d", r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)"}


@functools.lru_cache(1)
def _unlike() -> re.Pattern:
    """Characters of the basic plane on which the two engines may differ (one table in ``re``, so fast)."""
    odd = [c for c in range(0x10000) if unicodedata.category(chr(c)) in ("No", "Nl", "Cn", "Cs") or 0x1C <= c <= 0x1F]
    odd += [c for c in range(0x10000) if chr(c).isnumeric() and not chr(c).isdecimal() and not chr(c).isalpha()]
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in sorted(set(odd))) + "]")


def unlike(text: str) -> bool:
    """Whether the text holds a character on which engines may differ; those beyond the basic plane all count."""
    return bool(text) and (_unlike().search(text) is not None or (not text.isascii() and max(text) > "\uffff"))


@functools.lru_cache(8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists the matches of ``pattern`` (in the syntax of the rank files) in a text."""
    plain = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    fast = plain
    for own in sorted(FAST, key=len, reverse=True):
        fast = fast.replace(own, FAST[own])
    slow_find, fast_find = regex.compile(plain).findall, re.compile(fast).findall

    def split(text: str) -> list[str]:
        return slow_find(text) if unlike(text) else fast_find(text)

    return split
