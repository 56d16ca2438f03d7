"""Discovery, table reads and writes."""
