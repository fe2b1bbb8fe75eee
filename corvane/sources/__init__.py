"""Sources and sinks: corpus folders, question files, chunk files, expansion caches, submissions."""
