"""Source trees, log files and the persisted statement catalogue."""
