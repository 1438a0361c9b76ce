"""Frame to frame: tables with one row per value."""
