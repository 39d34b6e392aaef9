"""Tick analytics on Spark: as-of pricing, trading calendars, zone maps and session strategies."""
