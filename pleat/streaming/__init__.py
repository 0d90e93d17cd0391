"""What of the notation runs over a stream: elementwise verbs and filters, which need no order.

The notation has no event time, watermark or session; verbs that need positions are refused by name
on a streaming DataFrame (see ``Table``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..api import Language
from ..errors import NotYet
from ..plans.values import Table, Vec


def over_stream(language: Language, sentence: str, stream: DataFrame, hole_columns: dict[str, str], name: str = "v") -> DataFrame:
    """A sentence of elementwise verbs and filters over a streaming DataFrame, as a streaming DataFrame."""
    if not stream.isStreaming:
        raise NotYet("a batch table here; bind it with Table")
    t = Table(stream)
    value = language(sentence, {h: t[c] for h, c in hole_columns.items()}).value
    if not isinstance(value, Vec) or value.front or value.back:
        raise NotYet("this result over a stream: only elementwise verbs and filters keep no order and no state")
    out = value.to_df(name)
    if not out.isStreaming:
        raise NotYet("this result over a stream")
    return out
