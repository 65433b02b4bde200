"""Token counts by a tokenizer compiled to a finite-state transducer (see transducer.py).

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows count alike; an empty table gives an
empty result; any other column is left alone. Memory follows the largest slice of text, or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices, utf8
from .transducer import compiled

#: Text bytes tokenized together: distinct pieces are merged once for each slice.
TOKEN_SLICE = 600_000


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of documents (doc_id, text); a scan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", TOKEN_SLICE):
                data, at, _ = utf8(batch.column("text"))
                counts, _ = machine.run(data, at, False)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
