"""Project tokens and text measures.

A project token is a run of letters and digits after NFKC and case folding; a run of Han or kana characters
gives its characters and then its overlapping pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Han blocks and the kana blocks as inclusive code point ranges (fixed values).
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))
CJK_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)

#: Words never searched for while a query has another word (fixed values).
STOP_WORDS = tuple(
    "a an and are as at be been by can could did do does for from had has have how i if in is it its me my of on or our s should that"
    " the their them then there these they this to us was were what when where which who why will with would you your".split()
)

#: Ids that name nobody, compared without case and outer blanks (fixed values).
PLACEHOLDERS = ("", "-", "--", "0", "?", "n/a", "na", "nan", "nil", "none", "null", "unknown", "undefined", "anonymous")

# Python's \w is letters, digits, other numbers and the underscore, but also leaves out nothing of L* and N*
_RUNS = re.compile(f"([{CJK_CLASS}]+)|([^\\W_{CJK_CLASS}]+)")


def token_list(text: str | None) -> list[str]:
    """Project tokens of one text, repeated ones kept, in order; none for null."""
    if not text:
        return []
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    out: list[str] = []
    for cjk, word in _RUNS.findall(folded):
        if word:
            out.append(word)
        else:
            out.extend(cjk)
            out.extend(cjk[i : i + 2] for i in range(len(cjk) - 1))
    return out


@F.pandas_udf(ArrayType(StringType()))
def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrow UDF of ``token_list``."""
    for batch in texts:
        yield batch.map(token_list)


def is_plain(text: Column) -> Column:
    """True where ASCII only, so that lower case and a regular expression give the exact tokens inside the JVM."""
    return text.rlike(r"\A\p{ASCII}*\z")


def plain_tokens(text: Column) -> Column:
    """Tokens of an ASCII text, all inside the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space collapsed to single blanks and cut at both ends; case stays."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
