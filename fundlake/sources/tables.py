"""Named tables: checked scan, append, replace, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fundlake import schemas


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class SchemaMismatch(ValueError):
    """A stored table lacks a declared column or stores it under another type."""


def check_schema(df: DataFrame, expected: T.StructType, name: str) -> DataFrame:
    """Project ``df`` to the declared columns, raising when one is missing or differs in type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in expected.fields:
        found = actual.get(field.name)
        if found is None:
            problems.append(f"{field.name}: missing")
        elif found != field.dataType:
            problems.append(f"{field.name}: {found.simpleString()}, want {field.dataType.simpleString()}")
    if problems:
        raise SchemaMismatch(f"table {name}: " + "; ".join(problems))
    return df.select(*expected.fieldNames())


def read(
    spark: SparkSession,
    name: str,
    directory: str,
    schema: T.StructType | None = None,
    suffix: str = "",
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Scan table ``name`` below ``directory``; column pruning and filters reach the files."""
    expected = schema or schemas.MODEL[name]
    df = spark.read.format(fmt).options(**options).load(f"{directory}/{name}{suffix}")
    return check_schema(df, expected, name)


def read_jdbc(spark: SparkSession, name: str, options: Mapping[str, str],
              schema: T.StructType | None = None) -> DataFrame:
    """The same scan against a database table; give partitionColumn/bounds to read in parallel."""
    df = spark.read.format("jdbc").options(**{"dbtable": f"app.{name}", **options}).load()
    return check_schema(df, schema or schemas.MODEL[name], name)


def _hadoop(spark: SparkSession, path: str):
    """The file system of the path, and the path as it names it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    system, at = _hadoop(spark, path)
    return system.exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    """The folder and those above it."""
    system, at = _hadoop(spark, path)
    system.mkdirs(at)


def switch(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``; the old folder goes only after that."""
    system, target = _hadoop(spark, path)
    _, fresh = _hadoop(spark, new)
    _, old = _hadoop(spark, f"{path}-{uuid.uuid4().hex}-old")
    had = system.exists(target)
    if had and not system.rename(target, old):
        raise OSError(f"{path} cannot be moved")
    if not system.rename(fresh, target):
        if had:
            system.rename(old, target)
        raise OSError(f"{new} cannot be moved to {path}")
    if had:
        system.delete(old, True)


def checked(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """``df`` as table ``name`` declares it: raises before anything is written when a column is missing, of
    another type, or not declared. A table that is not declared is taken as it is."""
    expected = schema or schemas.MODEL.get(name)
    if expected is None:
        return df
    unknown = sorted(set(df.columns) - set(expected.fieldNames()))
    if unknown:
        raise SchemaMismatch(f"table {name}: {', '.join(unknown)}: not declared")
    return check_schema(df, expected, name)


def append(df: DataFrame, name: str, directory: str, schema: T.StructType | None = None) -> None:
    """Add the rows of ``df`` to table ``name``; existing rows stay. The frame is checked first."""
    checked(df, name, schema).write.mode("append").parquet(f"{directory}/{name}")


def stage(df: DataFrame, name: str, directory: str, schema: T.StructType | None = None) -> None:
    """Replace table ``name`` by ``df``: checked, written beside it, then switched. ``df`` may read the table itself."""
    path = f"{directory}/{name}"
    new = f"{path}-{uuid.uuid4().hex}-new"
    checked(df, name, schema).write.parquet(new)
    switch(df.sparkSession, new, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new, empty folder name in the shared checkpoint folder of the cluster.

    Only a local session without ``spark.checkpoint.dir`` falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="fundlake-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run here go as soon as it has ended: nothing reads them again."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def write_packed(df: DataFrame, path: str) -> None:
    """The rows as a new Parquet folder, packed closely; no shuffle file is left behind."""
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back, so that they are computed once."""
    path = scratch(df.sparkSession, label)
    write_packed(df, path)
    return rests_on(df.sparkSession.read.schema(df.schema).parquet(path), path)


def rests_on(df: DataFrame, *paths: str) -> DataFrame:
    """``df``, with a note of the scratch folders that it alone reads."""
    df.scratch_folders = paths
    return df


def folders_of(df: DataFrame) -> tuple[str, ...]:
    """The scratch folders that only ``df`` reads."""
    return df.__dict__.get("scratch_folders", ())


def discard(*frames: DataFrame) -> None:
    """Delete the scratch folders of frames that nothing reads any more: what was made from them is stored itself."""
    for df in frames:
        for path in folders_of(df):
            system, at = _hadoop(df.sparkSession, path)
            system.delete(at, True)


class Tables(Mapping[str, DataFrame]):
    """Lazily opened tables, each DataFrame built once: ``t.fund_price`` or ``t["fund_price"]``."""

    def __init__(self, names: list[str], open_table: Callable[[str], DataFrame]):
        self._names = list(names)
        self._open = open_table
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._names:
                raise KeyError(name)
            self._frames[name] = self._open(name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as missing:
            raise AttributeError(name) from missing

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def replace(self, **frames: DataFrame) -> "Tables":
        """The same tables with some of them exchanged, e.g. an updated ``portfolio``."""
        other = Tables(sorted(set(self._names) | set(frames)), self.__getitem__)
        other._frames.update(frames)
        return other


def stored_tables(spark: SparkSession, directory: str) -> Tables:
    """The data model as Parquet folders below ``directory``."""
    return Tables(list(schemas.MODEL), lambda name: read(spark, name, directory))
