"""Windowed refits of a stream: moments are mergeable, so they fit event-time windows."""

from latentspark.streaming.windows import fit_windows, windowed_moments, write_fits

__all__ = ["fit_windows", "windowed_moments", "write_fits"]
