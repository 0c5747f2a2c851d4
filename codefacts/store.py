"""Where facts live: Parquet tables in a folder that all executors share.

A store is a folder with one table per fact kind and a one-row ``meta``. ``sym`` is sorted by name
and ``call`` by callee, so that row-group statistics prune name look-ups; ``edge``, the distinct
resolved caller-callee pairs, is kept besides and sorted by callee for traversal. Several
repositories are several stores, read side by side by ``repositories``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import INDEX_VERSION, SCHEMAS

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests, local mode) the
    first call makes a temporary folder and keeps it in the session's own setting.
    """
    there = spark.conf.get(_CHECKPOINT, None) or spark.conf.get("codefacts.shared.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT} to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="codefacts-")
        spark.conf.set("codefacts.shared.dir", there)
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application. Where it is on
    their path already (PYTHONPATH, or the working directory in local mode) nothing is sent."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (sc.master.startswith("local[") and Path.cwd() == root):
        return
    path = f"{tempfile.mkdtemp(prefix='codefacts-')}/codefacts.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "codefacts").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a cache, the files outlive lost executors. ``keep`` collects the paths, for ``drop``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()


@dataclass
class Facts:
    """The fact tables. ``lines`` (file_id, ln, text) reads the live sources, not the store."""

    file: DataFrame
    sym: DataFrame
    call: DataFrame
    ref: DataFrame
    extref: DataFrame
    impl: DataFrame
    meta: DataFrame
    lines: DataFrame | None = None
    edge: DataFrame | None = None
    paths: list[str] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.sym.sparkSession

    def edges(self) -> DataFrame:
        """Distinct (caller, callee_sym) of the resolved calls, as stored."""
        if self.edge is not None:
            return self.edge
        return self.call.where(F.col("callee_sym").isNotNull()).select("caller", "callee_sym").distinct()


_ORDER = {"sym": ["name", "sym_id"], "call": ["callee", "call_id"], "ref": ["sym_id"], "extref": ["symbol"], "file": ["path"], "impl": ["trait_name"]}


def save(facts: Facts, path: str) -> Facts:
    """Write every table under ``path`` and open it. A table is dealt by its look-up key in ranges,
    so a value that is everywhere (a hot name) spans files instead of making one huge file."""
    for name in SCHEMAS:
        table = getattr(facts, name).select(*SCHEMAS[name].fieldNames())
        if name in _ORDER:
            table = table.repartitionByRange(*_ORDER[name]).sortWithinPartitions(*_ORDER[name])
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    call = facts.spark.read.schema(SCHEMAS["call"]).parquet(f"{path}/call")
    edge = call.where(F.col("callee_sym").isNotNull()).select("caller", "callee_sym").distinct()
    edge.repartitionByRange("callee_sym", "caller").sortWithinPartitions("callee_sym", "caller").write.mode("overwrite").parquet(f"{path}/edge")
    out = load(facts.spark, path, facts.lines)
    out.paths = [path]
    return out


def load(spark: SparkSession, path: str, lines: DataFrame | None = None) -> Facts:
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}
    return Facts(**tables, lines=lines, edge=spark.read.schema("caller long, callee_sym long").parquet(f"{path}/edge"))


def version(facts: Facts) -> int | None:
    """The version that wrote the store; another one than ``INDEX_VERSION`` calls for a rebuild."""
    row = facts.meta.select("ver").first()
    return row["ver"] if row else None


def current(facts: Facts) -> bool:
    return version(facts) == INDEX_VERSION
