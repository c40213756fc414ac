"""Named end-to-end queries with their SQL counterparts."""
