"""Sentence-level text expressions.

Everything here returns a Catalyst ``Column`` so it runs inside the JVM
(whole-stage codegen where Spark supports it) and works both on sentence
rows and inside ``transform`` lambdas over an article's sentence array.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for right results)
# token pattern, applied to the lower-cased sentence
TOKEN_PATTERN = r"[A-Za-z']+"
# modal / hedging cue words, matched as whole words on the lower-cased sentence
MODAL_CUES = ("might", "could", "reportedly", "allegedly", "seems", "appears")
# default column values of an article record
DEFAULT_DOMAIN = "MBIB"
DEFAULT_SPLIT = "train"
# ---------------------------------------------------------------------------

# A "word character" is a letter, a digit or an underscore in any script.
# The explicit class keeps whole-word matching identical on every JVM (the
# meaning of \b changed between Java releases) and in RE2-based engines.
WORD_CLASS = r"\p{L}\p{N}_"
MODAL_PATTERN = rf"(^|[^{WORD_CLASS}])({'|'.join(MODAL_CUES)})($|[^{WORD_CLASS}])"

# Sentence boundary used by the document adapter (see sources.articles).
SENTENCE_SPLIT = r"[.!?\n]+\s*"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(sentence: Column | str) -> Column:
    """``array<string>`` of tokens of the lower-cased sentence."""
    return F.regexp_extract_all(F.lower(as_col(sentence)), F.lit(TOKEN_PATTERN), 0)


def has_quotes(sentence: Column | str) -> Column:
    """True when the original text holds a double quote or any apostrophe."""
    s = as_col(sentence)
    return (F.instr(s, '"') > 0) | (F.instr(s, "'") > 0)


def has_modal(sentence: Column | str) -> Column:
    """Whole-word match of one of the modal cue words."""
    return F.lower(as_col(sentence)).rlike(MODAL_PATTERN)


def count_in(token_array: Column, terms: Iterable[str]) -> Column:
    """Number of tokens (with repeats) that are in ``terms``.

    ``isin`` with more than a handful of literals is rewritten by Catalyst to
    a hash-set lookup (``INSET``), also inside the lambda, so the cost is one
    probe per token and no join or shuffle.
    """
    terms = sorted(set(terms))
    if not terms:
        return F.lit(0)
    return F.size(F.filter(token_array, lambda t: t.isin(terms)))


def any_in(token_array: Column, terms: Iterable[str]) -> Column:
    terms = sorted(set(terms))
    if not terms:
        return F.lit(False)
    return F.exists(token_array, lambda t: t.isin(terms))


def split_sentences(text: Column | str) -> Column:
    """Document text to a sentence array; blank pieces dropped."""
    return F.filter(F.split(as_col(text), SENTENCE_SPLIT), lambda x: F.trim(x) != "")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
