"""Formulas such as Surv(start, stop, event) ~ sex * factor(group) + offset(z), and the columns that they stand for."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a factor beyond which a model would have too many columns to fit.
MOST_LEVELS = 500

_VARIABLE = r"(?:factor\(\s*[\w.]+\s*\)|[\w.]+)"
_TERM = rf"{_VARIABLE}(?:\s*[:*]\s*{_VARIABLE})*"


@dataclass(frozen=True)
class Formula:
    start: str | None
    stop: str
    event: str
    covariates: tuple[str, ...]
    """Labels of the terms, main effects first; the variables of an interaction are joined by a colon."""
    offset: str | None = None

    def variables(self) -> list[str]:
        """Labels of all variables: columns, and factor(column)."""
        return list(dict.fromkeys(v for t in self.covariates for v in t.split(":")))

    def used(self) -> list[str]:
        """Columns on the right-hand side."""
        return list(dict.fromkeys([*map(column_of, self.variables()), *([self.offset] if self.offset else [])]))


def column_of(variable: str) -> str:
    return variable[len("factor(") : -1].strip() if variable.startswith("factor(") else variable


def _expanded(term: str) -> list[tuple[str, ...]]:
    """The interactions that a term of : and * stands for, of few variables first."""
    sides = [tuple(re.sub(r"\s", "", v) for v in part.split(":")) for part in term.split("*")]
    out = []
    for size in range(1, len(sides) + 1):
        out += [tuple(dict.fromkeys(v for side in chosen for v in side)) for chosen in combinations(sides, size)]
    return out


def parse(text: str, columns: Sequence[str] = ()) -> Formula:
    """Two or three columns in Surv; terms joined by + and taken away by -, and . for all other columns.

    A term is a column, factor(column), an interaction x:y of those, or x*y for x + y + x:y; offset(column) may stand once.
    """
    m = re.fullmatch(r"\s*Surv\(([^)]*)\)\s*~\s*(.+?)\s*", text)
    if not m:
        raise ValueError("expected Surv(...) ~ terms")
    response = [x.strip() for x in m[1].split(",")]
    if len(response) not in (2, 3) or not all(response):
        raise ValueError("Surv takes (time, status) or (start, stop, event)")
    if re.search(r"\b(?:strata|cluster|tt)\s*\(", m[2]):
        raise ValueError("strata, cluster and tt are not supported")
    offsets = re.findall(r"\boffset\(\s*([\w.]+)\s*\)", m[2])
    if len(offsets) > 1:
        raise ValueError("one offset at most")
    rest = re.sub(r"(^|[+])\s*offset\(\s*[\w.]+\s*\)", lambda x: x[1] + " 1", m[2])
    if not re.fullmatch(rf"-?\s*{_TERM}(?:\s*[+-]\s*{_TERM})*", rest):
        raise ValueError("terms are columns, factors and interactions joined by + and -")
    terms: list[tuple[str, ...]] = []
    for sign, term in re.findall(rf"([+-]?)\s*({_TERM})", rest):
        found = [(c,) for c in columns if c not in [*response, *offsets]] if term == "." else _expanded(term)
        if sign == "-":
            terms = [t for t in terms if set(t) not in map(set, found)]
        else:
            terms += [t for t in found if set(t) not in map(set, terms)]
    terms = sorted((t for t in terms if t not in (("1",), ("0",))), key=len)
    formula = Formula(response[0] if len(response) == 3 else None, response[-2], response[-1], tuple(":".join(t) for t in terms), offsets[0] if offsets else None)
    if columns and (missing := [c for c in [*response, *formula.used()] if c not in columns]):
        raise ValueError(f"no such columns: {missing}")
    return formula


@dataclass(frozen=True)
class Design:
    """The model's columns: each a product of numeric columns (level None) and indicators of a factor's level."""

    labels: tuple[str, ...]
    products: tuple[tuple[tuple[str, object], ...], ...]
    levels: dict[str, tuple]
    offset: str | None

    @property
    def names(self) -> list[str]:
        """Names of the columns that matrix() adds: a column of its own name where a label is that."""
        return [p[0][0] if len(p) == 1 and p[0][1] is None else f"__x{i + 1}" for i, p in enumerate(self.products)]

    def matrix(self, df: DataFrame) -> DataFrame:
        """df with the model's columns; null where a variable is null or a factor has a level that was not there when the model was made."""
        return df.withColumns({n: self._column(p) for n, p in zip(self.names, self.products) if n.startswith("__x")})

    def _column(self, parts: tuple[tuple[str, object], ...]) -> Column:
        out = F.lit(1.0)
        for c, level in parts:
            known = self.levels.get(c)
            value = F.col(f"`{c}`").cast("double") if known is None else F.when(F.col(f"`{c}`").isin(*known), (F.col(f"`{c}`") == F.lit(level)).cast("double"))
            out = out * value
        return out


def design(formula: Formula, df: DataFrame) -> Design:
    """Columns of the formula's terms on df: factors (also all columns of text or booleans) by their levels, found among the rows without nulls in used columns.

    A factor of a term has an indicator a level, but for the first level where the term without that factor is in the model too (the empty term always is), so
    that columns span what the terms say and no more.
    """
    kinds = dict(df.dtypes)
    is_factor = {v: v.startswith("factor(") or kinds[v] in ("string", "boolean") for v in formula.variables()}
    used = formula.used()
    whole = df.na.drop(subset=used) if used else df
    levels: dict[str, tuple] = {}
    for v, yes in is_factor.items():
        c = column_of(v)
        if yes and c not in levels:
            found = [r[0] for r in whole.select(F.col(f"`{c}`")).distinct().limit(MOST_LEVELS + 1).collect()]
            if len(found) > MOST_LEVELS:
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
            levels[c] = tuple(sorted(found))
    if mixed := [c for c in levels if any(column_of(v) == c and not yes for v, yes in is_factor.items())]:
        raise ValueError(f"both factors and numbers: {mixed}")
    terms = [tuple(t.split(":")) for t in formula.covariates]
    sets = [set(), *map(set, terms)]
    labels, products = [], []
    for term in terms:
        choices = []
        for v in term:
            c = column_of(v)
            if not is_factor[v]:
                choices.append([(v, (c, None))])
            else:
                first = 1 if set(term) - {v} in sets else 0
                choices.append([(f"{v}{level}", (c, level)) for level in levels[c][first:]])
        # the first variable's levels run fastest
        for chosen in product(*reversed(choices)):
            labels.append(":".join(label for label, _ in reversed(chosen)))
            products.append(tuple(part for _, part in reversed(chosen)))
    return Design(tuple(labels), tuple(products), levels, formula.offset)
