"""String column expressions: normalising, fuzzy similarity, value sniffing."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ledgerlens.functions.numbers import grouped_text, plain_text, rounded

# Fixed value: the value shapes that count as a written date.
DATE_SHAPES = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}")
# Fixed value: currency symbols and separators removed before a number is parsed.
CURRENCY_SYMBOLS = "[$,€£]"
# Fixed value: the shape of an e-mail address.
EMAIL_SHAPE = r"^[\w\.-]+@[\w\.-]+\.\w+$"


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def spaced(col: Column) -> Column:
    """Lower case with ``_`` and ``-`` turned into blanks."""
    return F.translate(F.lower(col), "_-", "  ")


def heading(col: Column) -> Column:
    """``order_total`` to ``Order Total``."""
    return F.initcap(F.translate(col, "_", " "))


def heading_text(name: str) -> str:
    return name.replace("_", " ").title()


def looks_like_date(col: Column) -> Column:
    return col.rlike("^(?:" + "|".join(DATE_SHAPES) + ")")


def strip_currency(col: Column) -> Column:
    return F.regexp_replace(col, CURRENCY_SYMBOLS, "")


def contains_any(text: Column, keywords: Column) -> Column:
    """Does ``text`` contain any element of the array ``keywords``?"""
    return F.exists(keywords, lambda word: text.contains(word))


def hits_in(text: Column, keywords: Column) -> Column:
    """Number of elements of the array ``keywords`` found in ``text``."""
    return F.size(F.filter(keywords, lambda word: text.contains(word)))


def indel_ratio(left: Column, right: Column) -> Column:
    """Normalised Indel similarity ``2 * LCS / (len(left) + len(right))`` in 0..1.

    The longest common subsequence is a fold over the characters of ``left``
    carrying one row of the dynamic programme.  Meant for column names, which
    are short.
    """
    right_chars = F.split(right, "")
    empty_row = F.transform(F.array_append(right_chars, F.lit("")), lambda _: F.lit(0))

    def next_row(row: Column, char: Column) -> Column:
        seed = F.array(F.lit(0))
        cells = F.sequence(F.lit(1), F.size(right_chars))

        def extend(acc: Column, j: Column) -> Column:
            cell = F.when(
                F.element_at(right_chars, j) == char, F.element_at(row, j) + 1
            ).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, j)))
            return F.array_append(acc, cell)

        return F.aggregate(cells, seed, extend)

    lcs = F.element_at(F.aggregate(F.split(left, ""), empty_row, next_row), -1)
    total = F.length(left) + F.length(right)
    return F.when((F.length(left) == 0) | (F.length(right) == 0), F.lit(0.0)).otherwise(
        F.try_divide(F.lit(2.0) * lcs, total.cast("double"))
    )


def hashed(col: Column) -> Column:
    """SHA-256 of an external identifier."""
    return F.sha2(col.cast("string"), 256)


def fill_template(template: str, cells: dict[str, Column]) -> Column:
    """Text with ``{name}``, ``{name:.2f}`` and ``{name:,.2f}`` replaced by columns."""
    pieces = []
    for part in re.split(r"(\{[^}]*\})", template):
        if part.startswith("{"):
            name, _, spec = part[1:-1].partition(":")
            if spec:
                digits = int(spec.strip(",")[1:-1])
                value = rounded(cells[name], digits)
                pieces.append(grouped_text(value, digits) if spec.startswith(",") else plain_text(value, digits))
            else:
                pieces.append(F.coalesce(cells[name].cast("string"), F.lit("")))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)
