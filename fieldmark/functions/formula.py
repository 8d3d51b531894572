"""R-style formulas compiled to named Columns.

``~ 1 + a + b*c + a:b + I(a^2) + log(a) + poly(a, 2)``; ``a*b`` adds main effects and the product
(for three factors: mains and the three-way product), ``-1`` or ``0`` drops the intercept at either
end.  A categorical variable gives a 0/1 column for each level but the first; an array column (one
value an occasion) gives a column for each occasion, and one of text for each occasion and level but the first.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Named = list[tuple[str, Column]]
MATH = {"log": F.ln, "exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan}
NAME = r"[A-Za-z_.][\w.]*"
MAX_DEGREE = 5


class FormulaError(ValueError):
    """A formula that can't be read, or that names what the data lack."""


@dataclass(frozen=True)
class Formula:
    """Terms of one parameter's formula, in order; an empty tuple is the intercept."""

    terms: tuple[tuple[str, ...], ...]
    text: str = "~1"
    variables: tuple[str, ...] = field(default=())


def _split(text: str, on: str) -> list[str]:
    """Parts of ``text`` at ``on`` outside parentheses."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            raise FormulaError(f"unbalanced parenthesis in {text!r}")
        if ch == on and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    if depth:
        raise FormulaError(f"unbalanced parenthesis in {text!r}")
    return [p.strip() for p in [*out, part]]


def parse(text: str) -> Formula:
    body = text.split("~", 1)[-1].strip()
    if not body:
        raise FormulaError("empty formula")
    intercept, terms = True, []

    def add(term: tuple[str, ...]) -> None:
        if term not in terms:
            terms.append(term)

    # a minus is only the removal of the intercept
    signed = re.sub(r"-\s*1(?![\w.(])", "+0", body)
    for part in _split(signed, "+"):
        if not part:
            continue
        if part == "0":
            intercept = False
        elif part == "1":
            continue
        elif len(stars := _split(part, "*")) > 1:
            for s in stars:
                add((s,))
            add(tuple(stars))
        else:
            add(tuple(_split(part, ":")))
    atoms = [a for t in terms for a in t]
    if any(not a for a in atoms):
        raise FormulaError(f"missing operand in {text!r}")
    names = []
    for a in atoms:
        names += [v for v in re.findall(rf"{NAME}+(?!\s*\()", a) if v not in names]
    return Formula((((),) if intercept else ()) + tuple(terms), text, tuple(names))


@dataclass(frozen=True)
class Data:
    """What a formula needs to know of a table: levels of its categorical columns, lengths of its arrays."""

    columns: tuple[str, ...]
    levels: Mapping[str, tuple]
    occasions: Mapping[str, int]


def describe(df: DataFrame, names: tuple[str, ...], occasions: int, max_levels: int = 10_000) -> Data:
    """Levels of string columns and array columns' lengths, in one aggregate."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise FormulaError(f"unknown covariates {missing}; the table has {df.columns}")
    kinds = dict(df.dtypes)
    text = [n for n in names if kinds[n] in ("string", "boolean")]
    levels = {}
    if text:
        count = df.agg(*[F.countDistinct(F.col(n)).alias(n) for n in text]).first()
        if big := [n for n in text if count[n] > max_levels]:
            raise FormulaError(f"too many levels: {big}")
        got = df.agg(*[F.array_sort(F.collect_set(F.col(n).cast("string"))).alias(n) for n in text]).first()
        levels = {n: tuple(got[n]) for n in text}
    for n in (n for n in names if kinds[n] in ("array<string>", "array<boolean>")):
        found = df.select(F.explode(n).alias("v")).select(F.col("v").cast("string").alias("v")).where("v is not null").distinct().limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise FormulaError(f"too many levels: {[n]}")
        levels[n] = tuple(sorted(r["v"] for r in found))
    return Data(tuple(df.columns), levels, {n: occasions for n in names if kinds[n].startswith("array")})


def _atom(text: str, data: Data) -> Named:
    if m := re.fullmatch(rf"poly\(\s*({NAME})\s*,\s*(\d+)\s*\)", text):
        degree = int(m[2])
        if not 1 <= degree <= MAX_DEGREE:
            raise FormulaError(f"degree of {text!r} isn't in 1..{MAX_DEGREE}")
        return [(f"poly({m[1]}, {degree}){k}", F.power(F.col(m[1]), F.lit(float(k)))) for k in range(1, degree + 1)]
    if m := re.fullmatch(r"I\((.+)\)", text):
        inner = m[1].replace("^", "**")
        if not re.fullmatch(rf"(?:\s|{NAME}|[\d.]+|\*\*|[-+*/()])+", inner):
            raise FormulaError(f"can't read {text!r}")
        return [(text, F.expr(re.sub(rf"({NAME}|[\d.]+|\([^()]*\))\s*\*\*\s*([\d.]+)", r"power(\1, \2)", inner)).cast("double"))]
    if m := re.fullmatch(r"(\w+)\((.+)\)", text):
        if m[1] not in MATH:
            raise FormulaError(f"unknown function in {text!r}")
        return [(text, MATH[m[1]](F.expr(m[2]).cast("double")))]
    if not re.fullmatch(NAME, text):
        raise FormulaError(f"can't read {text!r}")
    if text in data.occasions and text in data.levels:
        at = lambda t: F.element_at(text, t + 1).cast("string")
        levels = data.levels[text]
        if len(levels) < 2:
            return [(f"{text}_t{t}", F.lit(1.0)) for t in range(data.occasions[text])]
        return [(f"{text}_{v}_t{t}", F.when(at(t) == F.lit(v), 1.0).otherwise(0.0)) for t in range(data.occasions[text]) for v in levels[1:]]
    if text in data.occasions:
        return [(f"{text}_t{t}", F.element_at(text, t + 1).cast("double")) for t in range(data.occasions[text])]
    if text in data.levels:
        levels = data.levels[text]
        if len(levels) < 2:
            return [(text, F.lit(1.0))]
        return [(f"{text}_{v}", F.when(F.col(text).cast("string") == F.lit(v), 1.0).otherwise(0.0)) for v in levels[1:]]
    return [(text, F.col(text).cast("double"))]


def design(formula: Formula, data: Data) -> Named:
    """The formula's columns in order."""
    if missing := [v for v in formula.variables if v not in data.columns]:
        raise FormulaError(f"unknown covariates {missing}")
    out: Named = []
    for term in formula.terms:
        if not term:
            out.append(("(Intercept)", F.lit(1.0)))
            continue
        for combo in product(*[_atom(a, data) for a in term]):
            value = combo[0][1]
            for _, c in combo[1:]:
                value = value * c
            out.append((":".join(n for n, _ in combo), value))
    return out


def domain_checks(formula: Formula) -> list[tuple[str, Column]]:
    """(message, condition a row violates) for logarithms and square roots."""
    found = []
    for text in {a for t in formula.terms for a in t}:
        if m := re.fullmatch(r"(log|sqrt)\((.+)\)", text):
            bad = F.expr(m[2]) <= 0 if m[1] == "log" else F.expr(m[2]) < 0
            found.append((f"{text} needs {'positive' if m[1] == 'log' else 'non-negative'} values", bad))
    return found
