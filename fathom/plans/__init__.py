"""Plan-level helpers: written tables, checked broadcasts, graphs."""
