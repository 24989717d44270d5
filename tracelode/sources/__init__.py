"""Sources: files by listing, JSON lines, compressed logs, embedded databases, git logs, registries."""
