"""Landed snapshots: declared schemas, readers and the append sink."""
