"""The engine: index a source tree, keep it fresh, and ask it.

    engine = Engine(spark).index("/path/to/repo")
    engine.callers_confirmed("target").show()
    engine.refresh()

Every query of ``plans.queries`` is a method. Point look-ups pay a Spark job each; what Spark adds
is scale, many repositories at once, and bulk forms of the queries.
"""

from __future__ import annotations

import logging
import time
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import fnv1a, source_lines
from .operators import incremental
from .operators.resolve import references, resolve, resolve_precise
from .plans import commands, queries
from .schema import CALL, EXTREF, INDEX_VERSION, META, REF, SCHEMAS
from .sources import rust, scip, tree
from .store import Facts, current, drop, fresh_path, save, written


log = logging.getLogger(__name__)
#: Fixed value: changed files since a precise index was read at which a new one is advised.
MANY_CHANGED = 20


def lines_of(sources: DataFrame, file: DataFrame) -> DataFrame:
    """(file_id, ln, text) of the live sources of indexed files."""
    rows = sources.join(file.select("file_id", "path"), "path").select("file_id", F.posexplode(source_lines(F.col("text"))).alias("i", "text"))
    return rows.select("file_id", (F.col("i") + 1).alias("ln"), "text")


class Engine:
    """Facts of one source tree. ``store`` is the folder for them; by default a new shared one."""

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark = spark
        self.store = store
        self.root: str | None = None
        self.scip: str | None = None
        self.facts: Facts | None = None
        self._behind: list[str] = []

    def index(self, root: str, scip_index: str | None = None) -> Engine:
        """Extract, resolve and store everything under ``root``; an index file makes it precise."""
        self.root, self.scip, spark = root, scip_index, self.spark
        keep: list[str] = []
        sources = tree.sources(spark, root)
        file, sym, site, impl = rust.extract(sources, keep)
        if scip_index:
            seen = written(scip.occurrences(spark, scip_index, lines_of(sources, file), file), "occurrences", keep)
            at = seen.groupBy("rel_path", "line0", "col0").agg(F.max_by("symbol", "seq").alias("at"))
            place = sym.join(file.select("file_id", F.col("path").alias("rel_path")), "file_id").withColumns({"line0": F.col("line") - 1, "col0": F.col("col")})
            sym = written(place.join(at, ["rel_path", "line0", "col0"], "left").withColumn("symbol", F.coalesce("at", "symbol")).select(*sym.columns), "raw", keep)
            call = resolve_precise(site, sym, file, seen)
            ref, extref = references(seen, sym, file)
        else:
            call = resolve(site, sym)
            ref, extref = spark.createDataFrame([], REF), spark.createDataFrame([], EXTREF)
        now = int(time.time())
        meta = spark.createDataFrame([(root, now, file.count(), INDEX_VERSION, now if scip_index else None, 0)], META)
        facts = Facts(file, sym.drop("col"), call.select(*CALL.fieldNames()), ref, extref, impl, meta)
        self.store = self.store or fresh_path(spark, "store")
        self.facts = save(facts, f"{self.store}/v{time.time_ns()}")
        self.facts.lines = lines_of(sources, self.facts.file)
        drop(spark, keep)
        return self

    def _listing(self) -> DataFrame:
        """(path, crate_, text, hash, modificationTime) of what is on disk, hashed by the JVM."""
        h = fnv1a(F.col("text"))
        return tree.sources(self.spark, self.root).withColumn("hash", F.when(h == 0xFFFFFFFF, h.bitwiseXOR(1)).otherwise(h))

    def stale(self) -> DataFrame:
        """(path, status) of what differs from the store: by content, not by time stamps alone. A file
        that can't be parsed has no facts and counts as added."""
        return incremental.changed_files(self.facts.file, self._listing())

    def refresh(self) -> DataFrame:
        """Bring the facts up to date; (path, status) of what changed.

        Contents are hashed first; only files whose hash is another one are parsed, and only calls
        that they can affect are resolved again. If nothing changed, no fact table is written and
        only the time of the index moves. A store of another version, or facts that can't be read
        any more, are followed by a full rebuild.
        """
        if not current(self.facts):
            self.index(self.root, self.scip)
            return self.spark.createDataFrame([], "path string, status string")
        keep: list[str] = []
        now, old = int(time.time()), self.facts
        here = self._listing()
        changed = written(incremental.changed_files(old.file, here), "changed", keep)
        n = changed.count()
        nfiles = here.count() if n else None
        stamp = {"built_at": F.lit(now).cast("long"), "nfiles": F.lit(nfiles).cast("long") if n else F.col("nfiles")}
        if not n:
            self.facts.meta = written(old.meta.withColumns(stamp), "meta")
            return changed
        try:
            file, sym, site, impl = rust.extract(here.join(changed, "path", "left_semi"), keep)
            fresh = Facts(file, sym.drop("col"), old.call, old.ref, old.extref, impl, old.meta)
            after = incremental.refresh(old, fresh, site, changed, n)
            after.meta = after.meta.withColumns(stamp)
            self.facts = save(after, f"{self.store}/v{time.time_ns()}")
            self.facts.lines = lines_of(tree.sources(self.spark, self.root), self.facts.file)
            # Answers that a user still holds may read the version before; the one before that goes.
            drop(self.spark, [*self._behind, *keep[1:]])
            self._behind = old.paths
        except (AnalysisException, Py4JJavaError) as error:  # the old store is damaged or gone
            log.warning("refresh failed, rebuilding: %s", error)
            self.index(self.root, self.scip)
        if (late := self.facts.meta.first()["upd_since_bake"] or 0) >= MANY_CHANGED:
            log.warning("%d files changed since the precise index was read; read a new one", late)
        return changed

    def answer(self, command: str, *words: str, limit: int | None = queries.LIMIT) -> DataFrame:
        """The whole answer to ``callers``, ``refs``, ``read``, ``impact`` or ``tests`` of a name."""
        more = {} if command == "tests" else {"limit": limit}
        return getattr(commands, command)(self.facts, *words, **more)

    def __getattr__(self, name: str):
        f = getattr(queries, name, None)
        if name.startswith("_") or f is None or not callable(f):
            raise AttributeError(name)
        if self.facts is None:
            raise RuntimeError("index a tree first")
        return partial(f, self.facts)


__all__ = ["Engine", "SCHEMAS"]
