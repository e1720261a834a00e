"""Streaming: a fitted model scores a stream as it scores a table.

Encoders and models are ordinary ML transformers with fixed parameters, so scoring keeps no
state and needs no watermark. There are no other streaming operators in scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymark.operators.estimators import Fitted


def score_stream(stream: DataFrame, fitted: Fitted) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming table; use Fitted.predict for a batch one")
    return fitted.predict(stream)
