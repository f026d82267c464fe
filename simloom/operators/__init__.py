"""DataFrame operators over sequences, networks, alignments and metadata."""
