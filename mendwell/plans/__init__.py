"""A trade dataset over the test tables, three fault scenarios on it, and the
registered queries with their SQL counterparts."""
