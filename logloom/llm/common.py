"""What the operators share: reading tables, learning splits, and text columns worked on in Arrow batches."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# A Python worker holds one slice of texts at a time.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % F.lit(modulus)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice's texts hold about ``limit`` bytes; one text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def annotate(
    df: DataFrame,
    start: Callable[[], Callable[[list[str | None]], Sequence[Sequence]]],
    fields: list[T.StructField],
    text: str = "text",
) -> DataFrame:
    """Append columns computed from the text column, slice by slice.

    ``start`` runs once a task and returns the function from a list of texts to
    one sequence per field. A column of ``df`` that has the name of a new one
    is replaced.
    """
    taken = {f.name.lower() for f in fields}
    kept = df.select(*[c for c in df.columns if c.lower() not in taken])
    schema = T.StructType(kept.schema.fields + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for piece in slices(batch, at):
                made = work(piece.column(at).to_pylist())
                new = [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=schema.names)

    return kept.mapInArrow(run, schema)


KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, KINDS[kind])


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = np.uint64(1)  # stands for the hash of the end token, which is no word


def word_numbers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, A-Z in lower case, as numbers.

    Returns the numbers of all texts, each text followed by number 0, its end;
    how many numbers each text has; and a 64-bit hash for each number.
    """
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    known[b""] = 0
    numbers = array("I")
    sizes = []
    for text in texts:
        words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        numbers.extend(map(known.__getitem__, words))
        numbers.append(0)
        sizes.append(len(words) + 1)
    hashes = np.array([END, *map(xxhash.xxh3_64_intdigest, list(known)[1:])], np.uint64)
    return np.array(numbers, np.uint32), np.array(sizes, np.uint32), hashes


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of ordered pairs of hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
