"""Nested bodies of brace languages as `{ ... }`; strings and comments are left as they are."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is passed over whole: comments, raw strings, strings.
_WHOLE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)".*?(?:"\1(?!#)|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|[{}]""", re.S)


def collapse(text: str, keep: int = 1) -> str:
    """The text with every body deeper than `keep` levels as `{ ... }`."""
    out, at, depth, hidden = [], 0, 0, False
    for m in _WHOLE.finditer(text):
        c = m.group()
        if c == "{":
            depth += 1
            if depth == keep + 1 and not hidden:
                out += [text[at : m.start()], "{ ... }"]
                hidden = True
        elif c == "}":
            if hidden and depth == keep + 1:
                hidden, at = False, m.end()
            depth -= 1
    return "".join(out) + ("" if hidden else text[at:])


def collapsed(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(collapse, na_action="ignore")

    return run(text)
