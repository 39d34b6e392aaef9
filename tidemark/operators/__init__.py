"""DataFrame operators: as-of joins, range extrema, calendars, rolling statistics, strategy."""
