"""Over/under on a growing log of events, by Structured Streaming."""

from evkit.streaming.over_under import closed_windows, read_games, read_log, stream_games, stream_windows

__all__ = ["closed_windows", "read_games", "read_log", "stream_games", "stream_windows"]
