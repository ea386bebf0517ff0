"""Event streams: decoding, sessions and the citation ledger."""
