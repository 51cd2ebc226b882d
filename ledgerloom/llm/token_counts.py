"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, raw_strings, text_or_empty
from .tokens import PartCounter, splits_at_space, whole_tokens


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text, whole, without added tokens.

    ``vocabulary`` is the path of a tokenizers (.json) or sentencepiece (.model) file. A null text is
    empty and has 0 tokens; every row counts by itself, so repeated or null doc_ids all stay. The strings
    shipped to the workers are at most the vocabulary's.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary) if splits_at_space(vocabulary) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or PartCounter(vocabulary, whole.value)
            at, data = raw_strings(batch.column("text"))
            flat, ends = data.tobytes(), at.tolist()
            n = np.array(counter.count([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]), np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
