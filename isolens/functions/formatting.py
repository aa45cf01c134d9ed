"""Report cells and reason texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Superscript forms of a-z (there is none for q).
LETTERS = "abcdefghijklmnoprstuvwxyz"
SUPERSCRIPTS = "ᵃᵇᶜᵈᵉᶠᵍʰᶦʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ"


def superscript(c: Column | str) -> Column:
    return F.translate(col(c), LETTERS, SUPERSCRIPTS)


def fixed(c: Column | str, digits: int) -> Column:
    """Non-negative number with a fixed count of decimals, rounded on its exact binary value, ties to even.

    The fraction is scaled to whole 2^-56 steps, where every digit decision is integer arithmetic.
    """
    x = col(c)
    unit, ten = 1 << 56, 10**digits
    whole = F.floor(x)
    f = ((x - whole) * float(unit)).cast("bigint").cast("decimal(18,0)") * F.lit(ten)
    k = F.floor(f / F.lit(unit).cast("decimal(18,0)")).cast("bigint")
    rem = (f - k.cast("decimal(18,0)") * F.lit(unit).cast("decimal(18,0)")).cast("bigint")
    up = (rem > unit // 2) | ((rem == unit // 2) & (F.pmod(k, F.lit(2)) == 1))
    k = k + up.cast("int")
    carry = (k >= ten).cast("int")
    return F.concat((whole + carry).cast("string"), F.lit("."), F.lpad((k - carry * ten).cast("string"), digits, "0"))


def format_percent(n: Column | str, d: Column | str) -> Column:
    """``0%``, ``<0.1%``, a whole number, or one decimal; empty without a denominator."""
    count, denom = col(n), col(d)
    pct = 100.0 * F.try_divide(count, denom)
    return (
        F.when(denom <= 0, F.lit(""))
        .when(count == 0, F.lit("0%"))
        .when(pct < 0.1, F.lit("<0.1%"))
        .when(F.abs(pct - F.rint(pct)) < 1e-12, F.concat(F.rint(pct).cast("long").cast("string"), F.lit("%")))
        .otherwise(F.concat(fixed(pct, 1), F.lit("%")))
    )


def format_cell(n: Column | str, d: Column | str, letters: Column | None = None) -> Column:
    """``count (percent)`` with optional superscript letters."""
    pct = format_percent(n, d)
    sup = superscript(F.coalesce(letters, F.lit(""))) if letters is not None else F.lit("")
    return F.when(pct == "", F.lit("")).otherwise(
        F.concat(col(n).cast("string"), F.lit(" ("), pct, F.lit(")"), sup)
    )


def join_reasons(reasons: list[tuple[Column, Column | str]], sep: str = "|", ok: str | None = "PASS") -> Column:
    """Texts of the conditions that hold, joined; ``ok`` when none holds."""
    hit = F.concat_ws(sep, *[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in reasons])
    return hit if ok is None else F.when(hit == "", F.lit(ok)).otherwise(hit)
