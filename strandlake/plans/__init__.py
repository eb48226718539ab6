"""Set expressions over many tables: a definition text becomes one lazy DataFrame plan."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.setops import MODES, combined, joint_meta, limited, together
from ..operators.table import KmerTable

_SIGNS = {"*": "intersect", "+": "union", "-": "kmers_subtract", "~": "counters_subtract"}
_INPUT = re.compile(r"(\w+)\s*=\s*(\S+)((?:\s+-c[ix]\d+)*)\s*$")


def _input(name: str) -> str:
    """The column of an input; operations have columns called step_."""
    return f"input_{name}"


def _bound(made: Callable, x: str, y: str) -> Column:
    """made(x, y), in which the results of other steps stand once only: they would be copied into every place where they stand."""
    if x.startswith("input_") and y.startswith("input_"):
        return made(F.col(x), F.col(y))
    return F.get(F.transform(F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))), lambda p: made(p["x"], p["y"])), F.lit(0))


class Expression:
    """Parser of `a + min b * (c - d)`: * binds tighter, the others are left-associative; a mode may follow an operator.

    Each operation becomes a step that makes one column of two; each input is read once, however often it is named.
    """

    def __init__(self, text: str, tables: dict[str, KmerTable]):
        self.text, self.tables, self.used, self.steps = text, tables, [], []
        self.tokens = [(m.group(), m.start()) for m in re.finditer(r"\w+|\S", text)]
        self.at = 0

    def fail(self, what: str):
        place = self.tokens[self.at][1] if self.at < len(self.tokens) else len(self.text)
        raise ValueError(f"{what} at {place} in {self.text!r}")

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def plan(self) -> DataFrame:
        result = self._terms("+-~", lambda: self._terms("*", self._operand))
        if self.peek():
            self.fail(f"unexpected {self.peek()!r}")
        df = together({_input(n): self.tables[n] for n in dict.fromkeys(self.used)})
        for name, sign, mode, x, y in self.steps:
            df = df.withColumn(name, _bound(lambda a, b: combined(_SIGNS[sign], mode, a, b), x, y))  # noqa: B023
        return df.select("kmer", F.col(result).alias("count")).where("count > 0")

    def _terms(self, signs: str, operand: Callable):
        left = operand()
        while self.peek() and self.peek() in signs:
            sign = self.peek()
            self.at += 1
            mode = None
            if self.peek() in MODES:
                if sign == "-":
                    self.fail("no counter mode may follow -")
                mode = self.peek()
                self.at += 1
            right = operand()
            self.steps.append((f"step_{len(self.steps)}", sign, mode, left, right))
            left = self.steps[-1][0]
        return left

    def _operand(self):
        token = self.peek()
        if token == "(":
            self.at += 1
            inner = self._terms("+-~", lambda: self._terms("*", self._operand))
            if self.peek() != ")":
                self.fail("missing )")
            self.at += 1
            return inner
        if token in MODES or not re.fullmatch(r"\w+", token or " "):
            self.fail("an input is missing")
        if token not in self.tables:
            self.fail(f"unknown input {token!r}")
        self.at += 1
        self.used.append(token)
        return _input(token)


def evaluate(text: str, tables: dict[str, KmerTable], **limits: int) -> KmerTable:
    """The table of an expression over named tables; output limits default as for single operations."""
    bad = set(tables) & set(MODES)
    if bad:
        raise ValueError(f"names are counter modes: {sorted(bad)}")
    parsed = Expression(text, tables)
    df = parsed.plan()
    return limited(df, joint_meta([tables[n] for n in parsed.used]), **limits)


def _flags(text: str, names: dict[str, str]) -> dict[str, int]:
    out = {}
    for flag in text.split():
        m = re.fullmatch(r"-(c[ixs])(\d+)", flag)
        if not m or m[1] not in names:
            raise ValueError(f"unknown parameter {flag!r}")
        out[names[m[1]]] = int(m[2])
    return out


def complex_definition(text: str, load: Callable[[str], KmerTable]) -> tuple[str, KmerTable]:
    """(output path, table) of a definition with INPUT:, OUTPUT: and perhaps OUTPUT_PARAMS: sections."""
    section, parts = None, {"INPUT:": [], "OUTPUT:": [], "OUTPUT_PARAMS:": []}
    for line in filter(None, map(str.strip, text.splitlines())):
        if line in parts:
            section = line
        elif section is None:
            raise ValueError(f"line before the first section: {line!r}")
        else:
            parts[section].append(line)
    tables: dict[str, KmerTable] = {}
    for line in parts["INPUT:"]:
        m = _INPUT.match(line)
        if not m or m[1] in tables or m[1] in MODES:
            raise ValueError(f"bad input line: {line!r}")
        source, own = load(m[2]), _flags(m[3], {"ci": "min_count", "cx": "max_count"})
        tables[m[1]] = source.reduce(**own) if own else source
    if len(parts["OUTPUT:"]) != 1 or "=" not in parts["OUTPUT:"][0]:
        raise ValueError("one output line is needed")
    path, _, expression = parts["OUTPUT:"][0].partition("=")
    limits = _flags(" ".join(parts["OUTPUT_PARAMS:"]), {"ci": "min_count", "cx": "max_count", "cs": "max_counter"})
    return path.strip(), evaluate(expression.strip(), tables, **limits)
