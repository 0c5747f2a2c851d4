"""Scalar expressions over facts and source lines, all of them JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KINDS, RESOLUTIONS, ROLES, VISIBILITIES

#: Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME = 2166136261, 16777619


def _decoded(names: tuple[str, ...], code: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), code)


def kind_name(code: Column) -> Column:
    return _decoded(KINDS, code)


def vis_name(code: Column) -> Column:
    return _decoded(VISIBILITIES, code)


def res_name(code: Column) -> Column:
    return _decoded(RESOLUTIONS, code)


def role_name(role: Column) -> Column:
    """The first of def, write, import, read whose bit is set, else ref."""
    out = F.lit("ref")
    for bit, name in reversed(ROLES):
        out = F.when(role.bitwiseAND(bit) != 0, name).otherwise(out)
    return out


def qualified(container: Column, name: Column) -> Column:
    return F.when(container == "", name).otherwise(F.concat(container, F.lit("::"), name))


def symbol_label(path: Column | str = "path") -> Column:
    """``path:line<TAB>vis [async ]kind [Container::]name  (crate)[  #test]`` of a sym row."""
    c = F.col
    return F.concat(
        c(path) if isinstance(path, str) else path, F.lit(":"), c("line").cast("string"), F.lit("\t"), vis_name(c("vis")), F.lit(" "),
        F.when(c("is_async") == 1, "async ").otherwise(""), kind_name(c("kind")), F.lit(" "), qualified(c("container"), c("name")),
        F.lit("  ("), c("crate_"), F.lit(")"), F.when(c("is_test") == 1, "  #test").otherwise(""),
    )


def capped(line: Column, most: int) -> Column:
    """The trimmed line; of a longer one ``most`` characters and an ellipsis."""
    t = F.trim(line)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = F.char_length(digits) / 2
    # conv gives the byte's value; ANSI mode needs no care, as the state stays below 2^32 * 2^25.
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long")) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    places = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(FNV_START).cast("long"), step)


def source_lines(text: Column) -> Column:
    """The lines of a source: split at line feeds, one carriage return at an end gone, no last
    empty line."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.array_size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.char_length(x) - 1)).otherwise(x))


def call_shape(name: str) -> str:
    """A pattern of ``name(`` that is no part of a longer identifier."""
    return rf"(^|[^A-Za-z0-9_]){re.escape(name)}[ \t]*\("


def word_bound(word: str) -> str:
    """A pattern of ``word`` as a whole identifier."""
    return rf"(^|[^A-Za-z0-9_]){re.escape(word)}($|[^A-Za-z0-9_])"


def upper_median(values: Column) -> Column:
    """An aggregate: the element at n/2 of the sorted values, 0 without any; no interpolation."""
    got = F.sort_array(F.collect_list(values))
    return F.coalesce(F.get(got, F.floor(F.array_size(got) / 2).cast("int")), F.lit(0))


def as_flag(text: str) -> int:
    """1 for 1, true, yes and y, else 0."""
    return int(text in ("1", "true", "yes", "y"))
