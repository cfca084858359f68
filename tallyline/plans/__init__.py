"""Named queries over the derived tables and their SQL counterparts."""
