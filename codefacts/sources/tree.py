"""Source trees: the walk, package names, the repository's root, and the sources as a DataFrame."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def package_name(manifest: str) -> str | None:
    """The name in the ``[package]`` section of a manifest's text."""
    inside = False
    for line in manifest.splitlines():
        line = line.strip()
        if line.startswith("["):
            inside = line == "[package]"
        elif inside and line.split("=")[0].strip() == "name" and "=" in line:
            return line.split("=", 1)[1].split("#")[0].strip().strip("\"'") or None
    return None


def manifests(root: str) -> dict[str, str]:
    """Package name by folder, relative to the root, of the manifests that name one."""
    out = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d != "target" and not d.startswith(".")]
        if "Cargo.toml" in names and (name := package_name(Path(folder, "Cargo.toml").read_text(errors="replace"))):
            out[os.path.relpath(folder, root).replace(os.sep, "/")] = name
    return out


def repository_root(path: str) -> str | None:
    """The nearest folder up with ``.git``, else the topmost with a manifest, else none."""
    here = Path(path).resolve()
    chain = [here, *here.parents]
    for p in chain:
        if (p / ".git").exists():
            return str(p)
    top = [p for p in chain if (p / "Cargo.toml").is_file()]
    return str(top[-1]) if top else None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, crate_, modificationTime, content) of the ``.rs`` files under a root, by paths relative
    to it. Folders and files called ``target`` or starting with a dot are left out, whatever the root
    itself is called.

    The crate is that of the nearest folder up whose manifest names a package, else ``root``: each
    path's folders are joined with the manifests and the longest wins.
    """
    base = Path(os.path.abspath(root))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs")
    # The root goes by its length: it is no pattern.
    full = F.regexp_replace(F.col("path"), "^file:/*", "/")
    path = F.substr(full, F.lit(len(str(base).rstrip("/")) + 2))
    hidden = F.exists(F.split("path", "/"), lambda x: (x == "target") | x.startswith("."))
    files = read.load(_literal(str(base))).select(path.alias("path"), "modificationTime", "content").where(~hidden)
    found = manifests(str(base))
    if not found:
        return files.select("path", F.lit("root").alias("crate_"), "modificationTime", "content")
    parts = F.slice(F.split("path", "/"), 1, F.array_size(F.split("path", "/")) - 1)
    # Longest folder first; "." is the root itself.
    folders = F.transform(F.sequence(F.array_size(parts), F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, ".").otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    names = spark.createDataFrame(list(found.items()), "folder string, package string")
    near = (
        files.select("path", F.posexplode(folders).alias("far", "folder")).join(names, "folder")
        .groupBy("path").agg(F.min_by("package", "far").alias("package"))
    )
    return files.join(near, "path", "left").select("path", F.coalesce("package", F.lit("root")).alias("crate_"), "modificationTime", "content")


def _literal(path: str) -> str:
    """A path in which nothing is a wildcard."""
    return "".join(f"\\{c}" if c in "*?[]{}\\," else c for c in path)


def sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, crate_, text, modificationTime) of the sources under a root. A file that is no UTF-8
    is left out, like one that can't be parsed."""
    files = listing(spark, root).where(F.is_valid_utf8(F.col("content").cast("string")))
    return files.select("path", "crate_", F.col("content").cast("string").alias("text"), "modificationTime")
