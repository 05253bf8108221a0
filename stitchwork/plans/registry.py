"""Query catalog: name -> Spark plan, name -> equivalent SQL for the check."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- small builders for the check SQL -------------------------------------------------------

def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def sql_list(values: list) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_in(values: list) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sql_pick(values: list, index: str) -> str:
    return f"({sql_list(values)})[(({index}) % {len(values)}) + 1]"


def sql_draw_number(seed, key: str) -> str:
    """Affine, fifth power, affine, all modulo 2^31 - 1; the constants come from the seed's SHA-256."""
    words = struct.unpack(">4I", hashlib.sha256(str(seed).encode()).digest()[:16])
    a, b, c, d = (w % 2147483646 + 1 for w in words)
    m = 2147483647
    once = f"list_transform([(({key})::BIGINT % {m} * {a} + {b}) % {m}], lambda x: x * x % {m} * (x * x % {m}) % {m} * x % {m})[1]"
    return f"(({once} * {c} + {d}) % {m})"


def sql_uniform(seed, key: str) -> str:
    return f"({sql_draw_number(seed, key)}::DOUBLE / 2147483647::DOUBLE)"


def sql_weigh(draw: str, options: list, weights: list[float]) -> str:
    total, seen, cases = float(sum(weights)), 0.0, ""
    for option, weight in list(zip(options, weights))[:-1]:
        seen += weight
        cases += f" WHEN {draw} < {seen / total!r}::DOUBLE THEN {q(option)}"
    return f"(CASE{cases} ELSE {q(options[-1])} END)" if cases else q(options[-1])


def sql_choice(draw: str, options: list) -> str:
    return f"({sql_list(options)})[floor({draw} * {len(options)})::INT + 1]"


def sql_has(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


def sql_rules(text: str, rules: list[tuple], default) -> str:
    cases = " ".join(f"WHEN {sql_has(text, words)} THEN {q(target)}" for target, words in rules)
    return f"CASE {cases} ELSE {q(default)} END"


def sql_map(value: str, mapping: dict, default: str = "NULL") -> str:
    cases = " ".join(f"WHEN {value} = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {cases} ELSE {default} END"


def sql_synonyms(value: str, mapping: dict[str, list[str]], default: str) -> str:
    cases = " ".join(f"WHEN {value} IN {sql_in(v)} THEN {q(k)}" for k, v in mapping.items())
    return f"CASE {cases} ELSE {default} END"
