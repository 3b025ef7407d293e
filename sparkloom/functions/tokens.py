"""Token counts by an encoder, in Arrow batches; the vocabulary file is a parameter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The margin that estimates carry, and the tokens of a message's frame; fixed values.
MARGIN, FRAME = 1.1, 6

_encoders: dict[str, object] = {}


def _encoder(path: str):
    """The tokenizer of a vocabulary file, one for each worker."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def counter(path: str):
    """A column function: how many tokens a text has by the vocabulary at path, which all executors can read; null counts as empty."""

    def count(texts: pa.Array) -> pa.Array:
        encode = _encoder(path)
        return pa.array([len(encode.encode(x or "", add_special_tokens=False).ids) for x in texts.to_pylist()], pa.int64())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "long")


def estimate(tokens: Column) -> Column:
    """Tokens with the margin, rounded down, at least one."""
    return F.greatest(F.floor(F.greatest(tokens, F.lit(1)) * F.lit(MARGIN)).cast("long"), F.lit(1).cast("long"))
