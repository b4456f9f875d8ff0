"""Where records come from: tables, logs, and keyspaces derived from tables."""
