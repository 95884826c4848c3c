"""Incremental runs over a growing folder of captures."""
