"""SHA-256 of ordered rows of a key, streamed: no group is ever held as a whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbouring values are joined into pieces of about so many characters before they meet in the task of their key.
PIECE_CHARS = 1 << 16


def _names(keys: list[str], df: DataFrame) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def joined_pieces(df: DataFrame, keys: list[str], order: str, value: str, separator: str) -> DataFrame:
    """``df`` with runs of neighbouring values joined; a key of any size is spread over the tasks by ``order``.

    Returns the keys, ``order`` of the first value of each piece, and ``value``. An empty table gives no rows.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        for batch in batches:
            columns, out = [c.to_pylist() for c in batch.columns], []
            for *k, at, text in zip(*columns):
                if k != key or size >= PIECE_CHARS:
                    if held:
                        out.append((*key, first, separator.join(held)))
                    key, first, held, size = k, at, [], 0
                held.append(text)
                size += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(i).type) for i, c in enumerate(zip(*out))], names=batch.schema.names)
        if held:
            row = (*key, first, separator.join(held))
            yield pa.RecordBatch.from_arrays([pa.array([v], batch.schema.field(i).type) for i, v in enumerate(row)], names=batch.schema.names)

    rows = df.select(*keys, order, value).repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(join, f"{_names(keys, df)}, {_names([order], df)}, `{value}` string")


def ordered_sha256(df: DataFrame, keys: list[str], order: str, value: str, separator: str) -> DataFrame:
    """(keys, ``sha256``): lowercase SHA-256 of each key's values, ascending by ``order`` and joined by ``separator``.

    Nulls in ``value`` are not allowed; keys without rows are absent. A digest is sequential, so the rows of a key meet
    in one task, as a sorted stream; hand over :func:`joined_pieces` where a key may have very many short values.
    """
    mark = separator.encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, types = None, None, None
        for batch in batches:
            types, out = [f.type for f in batch.schema][: len(keys)], []
            *ids, texts = [batch.column(i).to_pylist() for i in [*range(len(keys)), len(keys) + 1]]
            for *k, text in zip(*ids, texts):
                if k != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(mark)
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types, pa.string()])], names=[*keys, "sha256"])
        if state:
            row = (*key, state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [*types, pa.string()])], names=[*keys, "sha256"])

    rows = df.select(*keys, order, value).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(digest, f"{_names(keys, df)}, sha256 string")
