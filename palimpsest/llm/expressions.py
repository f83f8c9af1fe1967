"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, also where `use` reads it inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def chars_in(text: Column, chars: str) -> Column:
    """How many code points of `text` are among `chars`."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def has_word(text: Column) -> Column:
    """Whether `text` holds anything besides white space."""
    return F.translate(text, WHITE, "") != ""
