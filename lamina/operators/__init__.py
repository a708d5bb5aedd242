"""DataFrame operators: structural and flagged codecs, dictionary and delta encoding, record schemas."""
