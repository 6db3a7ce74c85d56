"""Operators over the node table: clusters of dates, blocks, items, feed discovery, export."""
