"""Operators on fixes: tables with mmsi, i (place in the track), t (epoch seconds), lat, lon. Limits are the caller's: none has a default."""
