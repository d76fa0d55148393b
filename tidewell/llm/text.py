"""What the text operators share: words, folds of documents, and functions over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS = 5


def fold(key: Column) -> Column:
    """Fold of a document: crc32 of its id as text, modulo five; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS))


def raw(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """Words of the text after lower-casing A to Z only."""
    return text.lower().split()


def struct_udf(make: Callable[[], Callable[[bytes], tuple]], schema: T.StructType):
    """Arrow function over whole texts that returns one struct a row.

    ``make`` runs once a task and gives the function of one text, so caches live in it. The function
    is marked as not deterministic: Spark then evaluates it once, also where a filter reads it.
    """
    types = [pa_type(f.dataType) for f in schema.fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for texts in batches:
            rows = [of(x) for x in raw(texts)]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def value_udf(make: Callable[[], Callable[[bytes], object]], kind: T.DataType):
    """As ``struct_udf``, with one plain value a row."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for texts in batches:
            yield pa.array([of(x) for x in raw(texts)], pa_type(kind))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def pa_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, pa_type(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns that clash with what an operator adds; names compare without case."""
    clash = {n.lower() for n in names}
    return df.select(*(c for c in df.columns if c.lower() not in clash))


class Bounded(dict):
    """Cache of a function that starts anew when it holds ``most`` entries."""

    def __init__(self, function: Callable, most: int = 500_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value
