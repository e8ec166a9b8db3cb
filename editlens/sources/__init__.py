"""Readers and writers for manifests, ledgers, logs and payload files."""
