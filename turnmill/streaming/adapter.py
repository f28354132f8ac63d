"""Streams of turns: stages of single rows run on the stream itself, stages of conversations on each batch's whole conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import filler, structure
from ..plans.config import profile
from ..plans.engine import Compressor
from ..schema import canonical


def rows(stream: DataFrame, conv_type: str = "chat") -> DataFrame:
    """The structure and filler stages of a stream of turns; no state is kept."""
    strength = profile(conv_type).stages["structure"].aggressiveness
    return filler.filler(structure.structure(canonical(stream), strength), conv_type)


def conversations(stream: DataFrame, compressor: Compressor, write: Callable[[DataFrame, int], None], **kwargs) -> DataStreamWriter:
    """A writer that compresses each micro-batch; a batch must hold whole conversations, as files of finished ones do."""
    return stream.writeStream.foreachBatch(lambda batch, n: write(compressor.compress(batch, **kwargs).turns, n))
