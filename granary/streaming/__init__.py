"""Tables that grow while they are read."""

from granary.streaming.growth import Follower, follow, windowed_counts

__all__ = ["Follower", "follow", "windowed_counts"]
