"""Streaming forms.  The reference has no event-time streams; its only incremental
shape is the batch-wise update of metric counters, re-expressed here with
Structured Streaming (:mod:`vicinity.streaming.metric_counters`)."""
