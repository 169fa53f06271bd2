"""Readers and writers: inventories, fingerprints, tracklists, responses, logs."""
