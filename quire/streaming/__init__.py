from .jobs import dead_letter, dedup_stream, fan_out, land, latest_snapshot, stream_entries  # noqa: F401
