"""Token counts (operator 5): lengths only, in Arrow batches bounded by bytes.

Texts are cut at safe boundaries and their distinct chunks encoded in batches balanced by bytes
(see ``encode``). No ids leave the function.

Defined cases: NULL text is empty and has 0 tokens; special strings inside a text count as the
library counts them; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import prepare_python, whole_text
from haulframe.llm.encode import encoder


def token_counts(docs: DataFrame, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for each document."""
    prepare_python(docs.sparkSession)

    def count(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            n = enc.lengths(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pc.binary_length(batch["text"]).cast(pa.int64()),
                 pa.array(n.astype(np.int64)), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(
        count, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
