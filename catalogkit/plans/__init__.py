"""Reconciliation plans: tables that say what to copy, convert, move or delete."""
