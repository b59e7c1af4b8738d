"""Sources and sinks over files: messages, blobs, archives, artifacts."""
