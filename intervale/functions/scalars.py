"""Scalar functions as Columns: names, numbers out of text, ratios and logarithms, regions, patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that each integer type holds.
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def normalize_chrom(name: Column) -> Column:
    """The name without one leading ``chr``."""
    return F.when(name.startswith("chr"), F.substring(name, 4, 1 << 30)).otherwise(name)


def integer(text: Column) -> Column:
    """The decimal integer a text begins with, after white space; null if there is none or it doesn't fit."""
    return F.coalesce(_plain(text, "bigint"), F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"))


def _plain(text: Column, kind: str) -> Column:
    """The value of a text that is an integer as a whole, without a pattern; null for others. A cast also passes over control characters
    in front, which aren't white space, so the first character is looked at."""
    return F.when(text >= "+", text.try_cast(kind))


def lenient_integer(text: Column, kind: str = "bigint") -> Column:
    """Like ``integer``, but 0 where no number begins the text; null for a null text or where the type can't hold it."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(_plain(text, kind), F.when(text.isNull(), None).when(digits == "", F.lit(0)).otherwise(digits.try_cast(kind)).try_cast(kind))


def lenient_float(text: Column, kind: str = "double") -> Column:
    """The number a text begins with, or 0; null for a null text."""
    digits = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(text.isNull(), None).when(digits == "", F.lit(0.0)).otherwise(digits.try_cast(kind)).try_cast(kind)


def first_token(text: Column, most: int) -> Column:
    """The first run of other than white space, cut to ``most`` characters."""
    return F.substring(F.regexp_extract(text, r"(\S+)", 1), 1, most)


def field(line: Column, position: int) -> Column:
    """The tab-separated field at a position from 1, null beyond the last."""
    return F.get(F.split(line, "\t"), position - 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def binary_to_integer(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("bigint")


def safe_subtract(a: Column, b: Column) -> Column:
    """a - b, or 0 where that is negative."""
    return F.greatest(a - b, F.lit(0))


def log2fc(ratio: Column) -> Column:
    """log2 of a ratio; 0 where its size is below 1e-4."""
    return F.when(F.abs(ratio) < 1e-4, F.lit(0.0)).otherwise(F.log2(ratio))


def neg_log10(p: Column) -> Column:
    """-log10, infinite at 0."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log10(p))


def plot_log2fc(ratio: Column) -> Column:
    """The plotting scripts' form: 0 at exactly 0."""
    return F.when(ratio == 0, F.lit(0.0)).otherwise(F.log2(ratio))


def plot_neg_log10(p: Column) -> Column:
    """The plotting scripts' form: 6 at exactly 0."""
    return F.when(p == 0, F.lit(6.0)).otherwise(-F.log10(p))


def sanitize(name: Column) -> Column:
    """A file name without its suffix, blanks, slashes and brackets replaced, for use as a label."""
    return F.translate(F.regexp_replace(name, r"\.(bed|vcf)(\.gz)?$", ""), " /()", "____")


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int
    end: int


def parse_region(text: str) -> Region:
    """``chrom:start-end``; anything else is an error."""
    m = re.fullmatch(r"([^:]+):(\d+)-(\d+)", text.strip())
    if m is None:
        raise ValueError(f"not a region: {text!r}")
    return Region(re.sub("^chr", "", m[1]), int(m[2]), int(m[3]))


def parse_regions(text: str) -> list[Region]:
    """Regions separated by commas."""
    return [parse_region(x) for x in text.split(",") if x.strip()]


def region_column(text: Column) -> Column:
    """struct<chrom, start, end> of region texts; null where they aren't regions."""
    part = lambda i: F.regexp_extract(text, r"^(?:chr)?([^:]+):(\d+)-(\d+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("chrom"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("end")))


def java_pattern(basic: str) -> str:
    r"""A POSIX basic regular expression as a Java one.

    ``+ ? | ( ) { }`` stand for themselves and become operators behind a backslash; ``*`` is itself at the beginning of
    an expression or group; bracket expressions keep backslashes as members.
    """
    out: list[str] = []
    i, begins = 0, True
    while i < len(basic):
        c = basic[i]
        if c == "\\" and i + 1 < len(basic):
            d = basic[i + 1]
            out.append(d if d in "+?|(){}" else "\\" + d)
            begins = d in "(|"
            i += 2
            continue
        if c == "[":
            end = i + 1 + (basic[i + 1 : i + 2] == "^")
            end = basic.find("]", end + 1)
            while end > 0 and re.search(r"\[[:.=][^\]]*$", basic[i + 1 : end]):
                end = basic.find("]", end + 1)
            if end < 0:
                raise ValueError(f"no end of a bracket in {basic!r}")
            inner = basic[i + 1 : end].replace("\\", "\\\\").replace("&&", "&\\&")
            inner = re.sub(r"\[:(\w+):\]", lambda m: "\\p{" + m[1].capitalize().replace("digit", "Digit") + "}", inner)
            head = "^" if inner.startswith("^") else ""
            body = inner.removeprefix("^")
            out.append(f"[{head}{body.replace('[', chr(92) + '[')}]" if "]" not in body[:1] else f"[{head}\\]{body[1:].replace('[', chr(92) + '[')}]")
            i, begins = end + 1, False
            continue
        if c in "+?|(){}" or c == "*" and begins:
            out.append("\\" + c)
        elif c == "^" and not begins or c == "$" and i + 1 < len(basic) and basic[i + 1 : i + 3] not in ("\\)", "\\|"):
            out.append("\\" + c)
        else:
            out.append(c)
        begins = c == "^" and begins
        i += 1
    return "".join(out)


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Whether a name holds a match of one of the basic patterns; true without patterns."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(java_pattern(p))
    return out
