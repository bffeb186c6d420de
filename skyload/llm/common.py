"""What the operators share: whole texts as bytes, functions per document, stable random numbers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that the operators count as white space; ``bytes.split()`` uses the same six.
WHITE = " \t\n\x0b\x0c\r"


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def show_package_to_workers() -> None:
    """Let Python workers import this package from the folder the driver has it in, if they have no copy of their own."""
    session = SparkSession.getActiveSession()
    if session is not None:
        environment = session.sparkContext.environment
        paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
        if ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def arrow_function(function: Callable, kind: str):
    """A column function on Arrow arrays, run once per row even where several of its fields are read."""
    show_package_to_workers()
    return F.arrow_udf(function, kind).asNondeterministic()


def texts(column: pa.Array) -> Iterable[bytes]:
    """The texts of an Arrow array as UTF-8 bytes; null counts as empty."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def in_groups(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    """The texts in groups of about ``most`` bytes, one text at least."""
    group, filled = [], 0
    for text in texts(column):
        group.append(text)
        filled += len(text)
        if filled >= most:
            yield group
            group, filled = [], 0
    if group:
        yield group


#: Bytes of text whose results a Python worker holds as Python objects at a time; a batch holds up to 10,000 texts.
GROUP = 1 << 18


def per_text(function: Callable[[bytes], object], kind: str, arrow: pa.DataType) -> Callable[[Column | str], Column]:
    """A column function from ``function``, which takes one whole text as bytes.

    Spark hands over the text column alone, in Arrow batches; the other columns stay in the JVM. Results become Arrow
    data group by group, so that many or long results do not pile up as Python objects.
    """

    def apply(column: pa.Array) -> pa.Array:
        groups = [pa.array([function(text) for text in group], arrow) for group in in_groups(column, GROUP)]
        return pa.concat_arrays(groups) if groups else pa.array([], arrow)

    return arrow_function(apply, kind)


def uniform(*values: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the values alone, so reruns and retries agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *values), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
