"""Readers and writers of bars, manifests, archives, ledgers and documents."""
