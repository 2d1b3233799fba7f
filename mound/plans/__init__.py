"""Session settings, data flows, the pitch view and the query catalogue."""
