"""Text expressions: spacing, screening, canonical SQL text, defaults, argument lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.described_types import display_type, let, normal_type
from palimpsest.functions.names import unqualify

# Words a statement may not start with.
REFUSED_STARTS = ("\\", "copy ", "create database", "drop database")

# Quoted text, text between dollar marks with the same tag (the second group), quoted name, comments, then anything
# between them. Dollars behind a name belong to it. The single character at the end takes a mark that is never closed.
NAME = r"A-Za-z0-9_\x{80}-\x{10FFFF}"
QUOTED = r"""'[^']*(?:''[^']*)*+'|\$((?:[A-Za-z_][A-Za-z0-9_]*)?)\$[\s\S]*?\$\2\$|"[^"]*(?:""[^"]*)*+["]"""
COMMENT = r"""--[^\n]*|/\*[\s\S]*?\*/"""
WITH_COMMENTS = QUOTED + "|" + COMMENT + rf"""|[^'"/\-$]*[{NAME}]\$+|[^'"/\-$]+|[\s\S]"""
WITHOUT_COMMENTS = QUOTED + rf"""|[^'"$]*[{NAME}]\$+|[^'"$]+|[\s\S]"""

# `::type`, with words, modifiers and array marks that belong to the type.
CAST = (
    r"\s*::\s*[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)*(?:\s*\([^)]*\))?"
    r"(?:\s+(?:varying|precision|without|with|time|zone)\b)*(?:\s*\([^)]*\))?(?:\s*\[\])*"
)


def collapse_space(text: Column, limit: int | None = None) -> Column:
    """Whitespace runs become one blank; longer texts are cut to `limit` plus `...`."""
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    if limit is None:
        return one_line
    return F.when(F.length(one_line) > limit, F.concat(F.substring(one_line, 1, limit), F.lit("..."))).otherwise(one_line)


def screen_text(df: DataFrame, column: str, refused: Sequence[str] = REFUSED_STARTS, out: str = "problem") -> DataFrame:
    """Flag empty texts (`empty`) and texts that start with a refused word (that word).

    A word only counts on a word boundary and without regard to ASCII case; null otherwise.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    problem = F.when(text.rlike(r"^\s*\z"), F.lit("empty"))
    for word in refused:
        boundary = r"(?![A-Za-z0-9_])" if word[-1].isalnum() or word[-1] == "_" else ""
        quoted = "".join("\\" + ch if not (ch.isalnum() or ch in "_ ") else ch for ch in word)
        problem = problem.when(text.rlike(rf"(?i)^\s*{quoted}{boundary}"), F.lit(word.strip()))
    return df.withColumn(out, problem)


def canonical_text(text: Column) -> Column:
    """One form of a SQL text: case, comments, casts, default namespace and spacing.

    Quoted texts (also between dollar marks) and names are kept as written.
    """

    def without_comments(written: Column) -> Column:
        pieces = F.regexp_extract_all(written, F.lit(f"({WITH_COMMENTS})"), F.lit(1))
        kept = F.transform(pieces, lambda piece: F.when(piece.rlike(r"^(--|/\*)"), F.lit(" ")).otherwise(piece))
        return F.when(written.rlike(r"--|/\*"), F.array_join(kept, "")).otherwise(written)

    def plain(piece: Column) -> Column:
        lowered = F.lower(piece)
        # Most texts have neither of the two, and looking is cheaper than replacing.
        unnamed = F.when(lowered.contains("public"), F.regexp_replace(lowered, r"\bpublic\s*\.\s*", "")).otherwise(lowered)
        uncast = F.when(piece.contains("::"), F.regexp_replace(unnamed, CAST, "")).otherwise(unnamed)
        spaced = F.regexp_replace(uncast, r"\s+", " ")
        tight = F.regexp_replace(F.regexp_replace(spaced, r" ?([,)\]]) ?", "$1 "), r"([(\[]) ", "$1")
        return F.regexp_replace(tight, r" ([,)\]])", "$1")

    pieces = F.regexp_extract_all(without_comments(text), F.lit(f"({WITHOUT_COMMENTS})"), F.lit(1))
    kept = F.transform(pieces, lambda piece: F.when(piece.rlike(r"""^(?:['"].|\$[A-Za-z0-9_]*\$)"""), piece).otherwise(plain(piece)))
    return F.regexp_replace(F.array_join(kept, ""), r"^[\s]+|[\s;]+$", "")


def text_problem(text: Column) -> Column:
    """What a SQL text opens and never closes: `open text`, `open name`, `open dollar text` or `open comment`; null if nothing."""
    pieces = F.regexp_extract_all(text, F.lit(f"({WITH_COMMENTS})"), F.lit(1))
    left = F.array_join(F.filter(pieces, lambda p: (F.length(p) == 1) | ~p.rlike(r"""^(?:['"]|\$[A-Za-z0-9_]*\$|--|/\*)""")), "")
    return (
        F.when(left.contains("'"), "open text").when(left.contains('"'), "open name").when(left.contains("/*"), "open comment")
        .when(left.rlike(rf"(?<![{NAME}$])\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$"), "open dollar text")
    )


def canonical_default(expression: Column, column_type: Column) -> Column:
    """Default of a column: literals and null carry their type, sequences their bare name."""

    def of_plain(plain: Column) -> Column:
        sequence = unqualify(F.regexp_extract(plain, r"^nextval\( ?'(.+)' ?\)\z", 1))
        single = plain.rlike(r"^('[^']*(?:''[^']*)*+'|null)\z")
        shown = display_type(normal_type(display_type(column_type), "catalog"))
        return (
            F.when(plain == "", F.lit(""))
            .when(single, F.concat(plain, F.lit("::"), shown))
            .otherwise(
                let(
                    sequence,
                    lambda name: F.when(name != "", F.concat(F.lit("nextval('"), name, F.lit("'::regclass)"))).otherwise(plain),
                )
            )
        )

    return let(canonical_text(F.coalesce(expression, F.lit(""))), of_plain)


def split_top_level(text: Column) -> Column:
    """Arguments of a list, split at commas outside (), [], in order."""
    pieces = F.split(text, ",", -1)
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit(False).alias("any")
    )

    def step(state: Column, piece: Column) -> Column:
        opened = F.length(F.regexp_replace(piece, r"[^(\[]", ""))
        closed = F.length(F.regexp_replace(piece, r"[^)\]]", ""))
        depth = state["depth"] + opened - closed
        text_so_far = F.when(state["any"], F.concat(state["open"], F.lit(","), piece)).otherwise(piece)
        ends = depth == 0
        return F.struct(
            F.when(ends, F.concat(state["done"], F.array(F.trim(text_so_far)))).otherwise(state["done"]).alias("done"),
            F.when(ends, F.lit("")).otherwise(text_so_far).alias("open"),
            depth.alias("depth"),
            (~ends).alias("any"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["any"] & (F.trim(state["open"]) != ""), F.concat(state["done"], F.array(F.trim(state["open"])))).otherwise(
            state["done"]
        )

    split = F.aggregate(pieces, start, step, finish)
    whole = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(whole)
