"""Typed metadata columns of interval lines, and predicates on them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from intervale.functions.scalars import field, first_token, lenient_float, lenient_integer

#: Declared types and the Spark types that hold them.
TYPES = {"CHAR": "string", "INT_8": "tinyint", "INT_16": "smallint", "INT_32": "int", "INT_64": "bigint", "FLOAT": "float", "DOUBLE": "double", "STRING": "string"}
OPERATORS = ("==", "!=", "<=", ">=", "<", ">")


@dataclass(frozen=True)
class MetaColumn:
    position: int
    name: str
    kind: str
    size: int | None = None

    def parse(self, line: Column) -> Column:
        """The typed value in a line: numbers as far as the text goes, 0 where it has none; the first token of a string, cut
        to the declared length; the first character of a CHAR."""
        text = field(line, self.position)
        if self.kind == "STRING":
            return first_token(text, self.size)
        if self.kind == "CHAR":
            return F.substring(text, 1, 1)
        spark_type = TYPES[self.kind]
        return lenient_float(text, spark_type) if self.kind in ("FLOAT", "DOUBLE") else lenient_integer(text, spark_type)

    def literal(self, text: str) -> Column:
        """A literal of a predicate in this column's type."""
        if self.kind == "STRING":
            return F.lit((text.split() or [""])[0][: self.size])
        if self.kind == "CHAR":
            return F.lit(text.strip()[:1])
        m = re.match(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+)" if self.kind in ("FLOAT", "DOUBLE") else r"\s*[+-]?\d+", text)
        number = m[0].strip() if m else "0"
        if self.kind == "FLOAT":
            return F.lit(number).cast("float")
        return F.lit(float(number)) if self.kind == "DOUBLE" else F.lit(int(number))


def parse_conf(text: str) -> list[MetaColumn]:
    """Declarations ``<column from 1> <name> <type> [length]``, one a line; names and columns must not repeat."""
    out: list[MetaColumn] = []
    for line in text.splitlines():
        part = line.split()
        if not part:
            continue
        if len(part) < 3 or not part[0].isdigit() or int(part[0]) < 1:
            raise ValueError(f"not a declaration: {line!r}")
        kind = part[2].upper()
        if kind not in TYPES:
            raise ValueError(f"no such type: {part[2]}")
        size = None
        if kind == "STRING":
            if len(part) < 4 or not part[3].isdigit() or not 1 <= int(part[3]) <= 254:
                raise ValueError(f"a string needs a length from 1 to 254: {line!r}")
            size = int(part[3])
        if len(part[1]) > 31:
            raise ValueError(f"a name of more than 31 characters: {part[1]}")
        if any(c.name == part[1] for c in out):
            raise ValueError(f"declared twice: {part[1]}")
        out.append(MetaColumn(int(part[0]), part[1], kind, size))
    if len(out) > 255:
        raise ValueError("more than 255 columns")
    return out


def typed(line: Column, conf: list[MetaColumn]) -> Column:
    """struct of all declared columns."""
    return F.struct(*(c.parse(line).alias(c.name) for c in conf))


def parse_where(conf: list[MetaColumn], text: str, prefix: str = "meta.") -> Column:
    """One predicate ``<column><operator><literal>``; strings compare by their bytes, numbers as numbers."""
    m = re.match(r"\s*([A-Za-z_]\w*)\s*(==|!=|<=|>=|<|>)(?!=)(.*)$", text, re.S)
    if m is None:
        raise ValueError(f"not a predicate: {text!r}")
    column = next((c for c in conf if c.name == m[1]), None)
    if column is None:
        raise ValueError(f"no such column: {m[1]}")
    left, right = F.col(prefix + column.name), column.literal(m[3].strip())
    return {"==": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[m[2]]
