"""Set-at-a-time operators over the catalog tables."""
