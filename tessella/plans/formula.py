"""Formulas such as ``price ~ depth + hash(item, dim=32, top=3, by="cover") + embed(genus, family, top=2) + sparse(item) + vectors(item, from="known") + onehot(soil)``.

A formula is tokenised and parsed to terms, checked against both tables'
columns, and lowered to an encoder. ``cbind(a, b)`` names several targets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .encoder import Encoder

_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_.][\w.]*)|(?P<number>\d+)|(?P<text>"[^"]*"|'[^']*')|(?P<mark>[~+(),=]))""")
CALLS = {"raw": set(), "hash": {"dim", "top", "bottom", "by"}, "embed": {"dim", "top", "bottom", "by"}, "onehot": set(), "sparse": {"dim", "top", "bottom", "by"}, "vectors": {"from", "by", "tune"}}


@dataclass
class Term:
    kind: str
    columns: list[str]
    options: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.kind}_{'_'.join(self.columns)}"


@dataclass
class Formula:
    targets: list[str]
    terms: list[Term]


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:].strip()[:10]!r} in the formula")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "the end")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        got = self.peek()
        if (kind and got[0] != kind) or (value and got[1] != value):
            raise ValueError(f"expected {value or kind}, got {got[1]}")
        self.at += 1
        return got[1]

    def names(self) -> list[str]:
        self.take("mark", "(")
        out = [self.take("name")]
        while self.peek()[1] == ",":
            self.take()
            out.append(self.take("name"))
        self.take("mark", ")")
        return out

    def call(self, kind: str) -> Term:
        self.take("mark", "(")
        term = Term(kind, [])
        while True:
            name = self.take("name")
            if self.peek()[1] == "=":
                self.take()
                if name not in CALLS[kind]:
                    raise ValueError(f"{kind}() has no option {name}")
                k, value = self.peek()
                self.take()
                term.options[name] = int(value) if k == "number" else value.strip("\"'")
            else:
                term.columns.append(name)
            if self.peek()[1] != ",":
                break
            self.take()
        self.take("mark", ")")
        if not term.columns:
            raise ValueError(f"{kind}() names no column")
        return term

    def formula(self) -> Formula:
        first = self.take("name")
        targets = self.names() if first == "cbind" and self.peek()[1] == "(" else [first]
        self.take("mark", "~")
        terms = [self.term()]
        while self.peek()[1] == "+":
            self.take()
            terms.append(self.term())
        if self.peek()[0]:
            raise ValueError(f"unexpected {self.peek()[1]}")
        return Formula(targets, terms)

    def term(self) -> Term:
        name = self.take("name")
        if self.peek()[1] == "(":
            if name not in CALLS:
                raise ValueError(f"unknown encoding {name}(); use {', '.join(CALLS)}")
            return self.call(name)
        return Term("numeric", [name])


def parse(text: str) -> Formula:
    return _Parser(text).formula()


def lowered(formula: Formula | str, units: DataFrame, obs: DataFrame | None, key: str = "unit_id", tables: dict[str, DataFrame] | None = None) -> Encoder:
    """The formula's encoder; a ValueError says what does not fit the tables. ``tables`` holds ``(item, vector)`` tables for ``vectors(column, from="name")``."""
    f = parse(formula) if isinstance(formula, str) else formula
    unit_types, obs_types = dict(units.dtypes), dict(obs.dtypes) if obs is not None else {}
    for table, types in (("units", unit_types), ("observations", obs_types)):
        if types and key not in types:
            raise ValueError(f"{table} lack the key {key}")
    for t in f.targets:
        if t not in unit_types:
            raise ValueError(f"target {t} is no column of the units")
    out = Encoder()
    for t in f.terms:
        by = t.options.get("by")
        if by and by not in obs_types:
            raise ValueError(f"by = {by} is no column of the observations")
        in_obs, in_units = all(c in obs_types for c in t.columns), all(c in unit_types for c in t.columns)
        if not in_obs and not in_units:
            raise ValueError(f"{', '.join(t.columns)}: not all in one table")
        if t.kind == "numeric":
            c = t.columns[0]
            source = "units" if in_units else "obs"
            if (unit_types if in_units else obs_types)[c] == "string":
                raise ValueError(f"{c} is categorical; write onehot({c}), embed({c}) or hash({c})")
            out.add_numeric(t.name, t.columns, source)
        elif t.kind == "vectors":
            name = t.options.get("from")
            if name not in (tables or {}):
                raise ValueError(f"vectors({t.columns[0]}): no table {name}")
            out.add_vectors(t.name, t.columns[0], name, tables[name], by, "obs" if in_obs else "units", bool(t.options.get("tune")))
        elif t.kind in ("raw", "onehot"):
            getattr(out, f"add_{t.kind}")(t.name, t.columns, source="units" if in_units else "obs")
        else:
            getattr(out, f"add_{t.kind}")(t.name, t.columns, source="obs" if in_obs else "units", **t.options)
    return out
