"""Keyed, updatable tables on Spark: typed tables, ordered batches, a durable change log, replay and compaction."""
