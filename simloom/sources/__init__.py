"""Readers and writers for sequence, network, alignment, embedding and metadata files."""
