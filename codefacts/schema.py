"""Schemas of the fact tables and the codes of their enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations, stored by position.
KINDS = ("fn", "method", "struct", "enum", "trait", "const")
VISIBILITIES = ("pub", "crate", "restricted", "priv")
RESOLUTIONS = ("unresolved", "unique", "qualified", "ambiguous")
LANGUAGES = ("rust",)
#: Bits of a role, the one that names it first.
ROLES = ((1, "def"), (4, "write"), (2, "import"), (8, "read"))
UNRESOLVED, UNIQUE, QUALIFIED, AMBIGUOUS = range(4)
FN, METHOD, STRUCT, ENUM, TRAIT, CONST = range(6)
INDEX_VERSION = 4


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in (x.split() for x in text.split(","))])


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}

FILE = _schema("file_id long, path string, crate_ string, lang int, loc int, hash long")
SYM = _schema(
    "sym_id long, name string, kind int, vis int, is_async int, is_test int, file_id long, module string, crate_ string, "
    "container string, symbol string, sig string, doc string, line int, end_line int"
)
#: ``col`` is the call's place in its line; it serves the position join.
SITE = _schema("call_id long, caller long, callee string, qual string, is_method int, file_id long, line int, col int")
CALL = _schema("call_id long, caller long, callee string, callee_sym long, res int, qual string, is_method int, file_id long, line int, col int")
REF = _schema("sym_id long, file_id long, line int, col int, role int")
EXTREF = _schema("symbol string, file_id long, line int, col int, role int")
IMPL = _schema("trait_name string, type_name string, file_id long, line int")
META = _schema("root string, built_at long, nfiles long, ver int, baked_at long, upd_since_bake long")
OCCURRENCE = _schema("rel_path string, line0 int, col0 int, symbol string, role int, seq long")

SCHEMAS = {"file": FILE, "sym": SYM, "call": CALL, "ref": REF, "extref": EXTREF, "impl": IMPL, "meta": META}
