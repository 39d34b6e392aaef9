"""Column functions: civil dates, nanosecond time, text formats."""
