"""Text normalisation Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation removed by the SQuAD normaliser, and the
# English articles it drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ["a", "an", "the"]

PUNCT_CLASS = "[" + "".join("\\" + ch if ch in "[]\\^-" else ch for ch in PUNCTUATION) + "]"


def squad_tokens(c: Column) -> Column:
    """lower -> drop punctuation -> whitespace tokens -> drop article tokens."""
    s = F.regexp_replace(F.lower(c), PUNCT_CLASS, "")
    toks = F.split(s, r"\s+")
    return F.filter(toks, lambda t: (t != "") & ~t.isin(*ARTICLES))


# The characters matched by the regex class \s (space, tab, LF, VT, FF, CR).
WHITESPACE = " \t\n\x0b\f\r"


def whitespace_tokens(c: Column) -> Column:
    """Whitespace-separated tokens, no empty strings.

    Built only from codegen'd functions: trim the whitespace characters off
    both ends, split on whitespace runs, and drop the one empty string an
    all-blank text leaves.
    """
    return F.array_remove(F.split(F.trim(c, F.lit(WHITESPACE)), r"\s+"), "")
