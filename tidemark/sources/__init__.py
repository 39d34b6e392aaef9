"""Readers and writers of tick files, positions, instants, snapshots and run logs."""
