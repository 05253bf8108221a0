"""Text and number helpers shared by the rule sets."""

from __future__ import annotations

from functools import reduce

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Unicode whitespace that counts as a blank when stripping or splitting.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
BLANKS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every Unicode blank from both ends (``trim`` alone drops spaces only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def clean_lower(c: Column | str) -> Column:
    return F.lower(strip(F.coalesce(col(c), F.lit(""))))


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), BLANKS), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def lines(c: Column | str) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(col(c), LINE_BREAK), strip), lambda x: x != "")


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def sql_value(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


# Long literal lists go to Spark as one SQL expression: one call instead of one per entry.

def literals(values: list) -> Column:
    return F.expr("array(" + ", ".join(sql_value(v) for v in values) + ")")


def literal_map(mapping: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_value(k)}, {sql_value(v)}" for k, v in mapping.items()) + ")")


def contains_any(c: Column | str, needles: list[str]) -> Column:
    """Substring test against a short literal list.

    A column name gives a chain of plain searches, best for long texts that
    are already a column. An expression is searched by one alternation of
    quoted literals, so it is evaluated once.
    """
    if isinstance(c, str):
        return F.expr(" OR ".join(f"contains({c}, {sql_value(n)})" for n in needles))
    return c.rlike("|".join(f"\\Q{n}\\E" for n in needles))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def has_word(c: Column, alternatives: str) -> Column:
    """Whole-word match with Unicode-aware boundaries."""
    return c.rlike(f"(?U)\\b(?:{alternatives})\\b")


def pick(values: list, index: Column) -> Column:
    """values[index mod len], zero-based."""
    return F.element_at(literals(values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def first_rule(c: Column | str, rules: list[tuple], default) -> Column:
    """The target of the first rule with a keyword inside ``c``."""
    if isinstance(c, str):
        cases = " ".join("WHEN " + " OR ".join(f"contains({c}, {sql_value(k)})" for k in keywords)
                         + f" THEN {sql_value(target)}" for target, keywords in rules)
        return F.expr(f"CASE {cases} ELSE {sql_value(default)} END")
    out = None
    for target, keywords in rules:
        hit = contains_any(c, keywords)
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return out.otherwise(F.lit(default))


def lookup(c: Column, mapping: dict, otherwise: Column | None = None) -> Column:
    """Literal mapping; unmapped values give ``otherwise``."""
    if any(isinstance(v, Column) for v in mapping.values()):
        out = None
        for key, value in mapping.items():
            out = F.when(c == key, value) if out is None else out.when(c == key, value)
        return out if otherwise is None else out.otherwise(otherwise)
    found = F.try_element_at(literal_map(mapping), c)
    return found if otherwise is None else F.coalesce(found, otherwise)


def synonyms(c: Column, table: dict[str, list[str]], otherwise: Column) -> Column:
    """canonical -> spellings, as one literal map from spelling to canonical."""
    return F.coalesce(F.try_element_at(literal_map({s: k for k, ss in table.items() for s in ss}), c), otherwise)


def half_even(c: Column, digits: int) -> Column:
    """Round the binary value of a double, ties to even.

    ``round``/``bround`` work on the shortest decimal text of a double, so
    2.675 would go up although its binary value lies below the tie. Here
    ``x * 10^(digits+1)`` is split into a product and its exact error term,
    and the error decides apparent ties.
    """
    x = c.cast("double")
    scale = float(10 ** (digits + 1))
    big = x * 134217729.0
    high = big - (big - x)
    low = x - high
    product = x * scale
    error = (high * scale - product) + low * scale
    floor = F.floor(product / 10.0).cast("double")
    rest = product - floor * 10.0
    odd = F.pmod(floor, F.lit(2.0)) == 1.0
    up = (rest > 5.0) | ((rest == 5.0) & ((error > 0.0) | ((error == 0.0) & odd)))
    return (floor + F.when(up, 1.0).otherwise(0.0)) / float(10 ** digits)


def fixed(c: Column, digits: int) -> Column:
    """``%.{digits}f`` text with ties to even on the binary value."""
    return F.format_string(f"%.{digits}f", half_even(c, digits))


#: A prime below 2^31, so products of two residues stay inside a bigint. Raising to the fifth power permutes its residues.
DRAW_PRIME = 2**31 - 1


def sql_draw(seed: int | str, key: str) -> str:
    """Whole-number draw in [0, DRAW_PRIME) per row from a whole-number key (SQL text of any engine).

    Affine, fifth power, affine: every step is exact in bigint and a
    permutation, so keys below the prime never collide within a seed.
    """
    digest = hashlib.sha256(str(seed).encode()).digest()
    a, b, c, d = (int.from_bytes(digest[i:i + 4], "big") % (DRAW_PRIME - 1) + 1 for i in (0, 4, 8, 12))
    x = f"((CAST({key} AS BIGINT) % {DRAW_PRIME} * {a} + {b}) % {DRAW_PRIME})"
    square = f"({x} * {x} % {DRAW_PRIME})"
    return f"(({square} * {square} % {DRAW_PRIME} * {x} % {DRAW_PRIME} * {c} + {d}) % {DRAW_PRIME})"


def uniform(seed: int | str, key: str) -> Column:
    """Deterministic draw in [0, 1) per row from a key column, equal on every partitioning."""
    return F.expr(f"CAST({sql_draw(seed, key)} AS DOUBLE) / {float(DRAW_PRIME)!r}D")


def sql_weighted(draw: str, options: list, weights: list[float]) -> str:
    """Option whose cumulative weight first exceeds the draw (SQL text)."""
    total, running, cases = float(sum(weights)), 0.0, ""
    for option, weight in list(zip(options, weights))[:-1]:
        running += weight
        cases += f" WHEN {draw} < {running / total!r}D THEN {sql_value(option)}"
    return f"CASE{cases} ELSE {sql_value(options[-1])} END" if cases else sql_value(options[-1])


def sql_choose(draw: str, options: list) -> str:
    """Uniform choice by a draw in [0, 1) (SQL text)."""
    values = ", ".join(sql_value(o) for o in options)
    return f"element_at(array({values}), CAST(floor({draw} * {len(options)}) AS INT) + 1)"


def weighted(draw: str, options: list, weights: list[float]) -> Column:
    return F.expr(sql_weighted(draw, options, weights))


def choose(draw: str, options: list) -> Column:
    return F.expr(sql_choose(draw, options))
