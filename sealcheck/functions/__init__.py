"""Columns in, columns out: expressions over one packet, text or certificate."""
