"""Texts as the operators of this package see them, and small helpers around them."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z of UTF-8 bytes and turns all other ASCII but letters and digits to blanks;
#: bytes of other scripts stay, so words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode()))
#: Lower-cases A-Z only; split() then gives words of [^\x20\x09-\x0D]+.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes, lower-cased."""
    return text.translate(WORD_BYTES).split()


def whole(text: Column) -> Column:
    """The text, a null one being empty."""
    return F.coalesce(text, F.lit(""))


def lowered(text: Column) -> Column:
    return F.translate(whole(text), UPPER, LOWER)


#: Rows whose words and arrays a worker holds at once; more rows of a batch come after them.
ROWS = 512


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """``function`` makes the columns of ``schema`` out of some rows of ``df``, an Arrow batch, at a time."""
    names = [field.split()[0] for field in schema.split(",")]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for at in range(0, batch.num_rows, ROWS):
                made = function(batch.slice(at, ROWS))
                yield pa.RecordBatch.from_arrays([x if isinstance(x := made[n], pa.Array) else pa.array(x, TYPES[k])
                                                  for n, k in zip(names, kinds)], names=names)
    kinds = [field.split()[1] for field in schema.split(",")]
    return df.mapInArrow(batches, schema)


def kept_rows(df: DataFrame, keeps: Callable[[bytes], bool]) -> DataFrame:
    """The rows whose text is kept, with all columns as they are."""
    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array([keeps(t) for t in raw(part)], pa.bool_()))
    return df.mapInArrow(batches, df.schema)


TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
         "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a column of texts, null ones as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
