"""Column layouts of the tables that operators exchange."""

# One row per sequence, or several pieces of a sequence that is too long for one row: ``start`` is the
# position of the piece's first event, ``length`` and ``label`` belong to the whole sequence.
SEQUENCES = (
    "seq_id STRING, piece BIGINT, start BIGINT, events ARRAY<STRING>, label INT, length BIGINT, strategy STRING, "
    "block_id STRING, session_id BIGINT, window_start BIGINT, window_end BIGINT, time_span_seconds DOUBLE"
)
