"""Precise symbol occurrences: a reader of the protobuf wire format of SCIP index files.

An index holds documents (field 2); a document its path (1) and occurrences (2); an occurrence its
range (1, packed integers), symbol (2) and roles (3). Columns are UTF-8 bytes unless the document
says otherwise, and are turned into characters by the source's line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import ship

# Field numbers and wire types of the format.
DOCUMENTS, PATH, OCCURRENCES, RANGE, SYMBOL, ROLES = 2, 1, 2, 1, 2, 3
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == VARINT:
            value, at = _varint(data, at)
        elif kind == BYTES:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (FIXED32, FIXED64):
            n = 4 if kind == FIXED32 else 8
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def decode(data: bytes) -> Iterator[tuple[str, int, int, str, int, int]]:
    """(path, line, byte column, symbol, roles, place in the index) of each occurrence whose range
    has a line and a column."""
    seq = 0
    for number, value in fields(data):
        if number != DOCUMENTS or isinstance(value, int):
            continue
        path, found = "", []
        for n, v in fields(value):
            if n == PATH:
                path = v.decode()
            elif n == OCCURRENCES:
                place, symbol, roles = [], "", 0
                for k, x in fields(v):
                    if k == RANGE:
                        place += [x] if isinstance(x, int) else _packed(x)
                    elif k == SYMBOL:
                        symbol = x.decode()
                    elif k == ROLES:
                        roles = x
                if len(place) >= 2:
                    found.append((place[0], place[1], symbol, roles))
        for line, col, symbol, roles in found:
            yield path, line, col, symbol, roles, seq
            seq += 1


def char_column(line: Column, byte: Column) -> Column:
    """The character column of a UTF-8 byte column: the characters that begin before it. Past the
    line's end its length, without a line the byte column. A column inside a character counts it."""
    ascii_ = F.octet_length(line) == F.char_length(line)
    # Bytes that continue a character are 80 to BF; hex digits are two a byte.
    digits = F.hex(F.substring(F.encode(line, "UTF-8"), F.lit(1), byte))
    chars = F.char_length(F.regexp_replace(digits, "([0-7C-F])([0-9A-F])|[89AB][0-9A-F]", "$1"))
    return F.when(line.isNull(), byte).when(ascii_, F.least(byte, F.char_length(line))).otherwise(chars)


def occurrences(spark: SparkSession, index: str, lines: DataFrame, file: DataFrame) -> DataFrame:
    """(rel_path, line0, col0, symbol, role, seq) of an index file, with character columns.
    ``lines`` (file_id, ln, text) are the sources."""
    ship(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield pd.DataFrame(list(decode(content)), columns=["rel_path", "line0", "byte0", "symbol", "role", "seq"])

    raw = spark.read.format("binaryFile").load(index).select("content").mapInPandas(run, "rel_path string, line0 int, byte0 int, symbol string, role int, seq long")
    text = lines.join(file.select("file_id", F.col("path").alias("rel_path")), "file_id").select("rel_path", (F.col("ln") - 1).cast("int").alias("line0"), "text")
    met = raw.join(text, ["rel_path", "line0"], "left")
    return met.select("rel_path", "line0", char_column(F.col("text"), F.col("byte0")).cast("int").alias("col0"), "symbol", "role", "seq")


def thin(occurrence: DataFrame, file: DataFrame) -> bool:
    """Whether an index covers less than half of the source files, which hints at a failed run."""
    return 2 * occurrence.select("rel_path").distinct().count() < file.count()
