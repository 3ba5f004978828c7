"""Operators that keep no state between rows, over streams.

The projections and filters of cladeforge.operators take streaming tables as they are;
here they are chained between a stream of sequence records and a sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cladeforge.operators import sequences as S


def curated(stream: DataFrame, num_degenerates: int = 5, homopolymer_length: int = 8, min_length: int = 1) -> DataFrame:
    """Gaps removed, RNA as DNA, and sequences of poor quality dropped."""
    return S.cull_seqs(S.reverse_transcribe(S.degap_seqs(stream, min_length)), num_degenerates, homopolymer_length)


def write(stream: DataFrame, path: str, checkpoint: str, curate: Callable[[DataFrame], DataFrame] = curated) -> StreamingQuery:
    """Appends what a stream has available, curated, to Parquet files, once each."""
    out = curate(stream).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
