"""The usage aggregate on a stream of usage lines."""

from spendframe.streaming.usage import cost_by_period_stream

__all__ = ["cost_by_period_stream"]
