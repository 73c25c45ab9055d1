"""Regular expressions in Java's dialect, with every class spelt out.

White space includes the no-break space, line separators and the byte order mark; digits are ASCII; case-insensitive
patterns carry (?iu), since (?i) alone leaves letters beyond ASCII as they are.
"""

from __future__ import annotations

import re

SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
LETTER = "\\p{L}\\p{M}"
WS, WS_PLUS = f"[{SPACE}]", f"[{SPACE}]+"

#: Space, number, word and punctuation, in this order; together they cover every text.
NUMBER, WORD = "[0-9]+(?:[.,:][0-9]+)*(?:[.]|e|te|ten)?", f"['’]?[{LETTER}]+(?:['’\\-][{LETTER}]+)*['’]?"
TOKEN = f"[{SPACE}]+|{NUMBER}|{WORD}|[^{SPACE}{LETTER}0-9]"
TERM = f"[{LETTER}]+(?:['’][{LETTER}]+)*"
NOT_BEFORE, NOT_AFTER = f"(?<![{LETTER}])", f"(?![{LETTER}])"

_SPECIAL = re.compile(r"([.*+?^${}()|\[\]\\])")


def escaped(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def any_of(words) -> str:
    return "|".join(escaped(w) for w in words)
