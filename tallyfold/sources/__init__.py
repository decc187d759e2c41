"""Readers and writers of ledgers, records, blobs and result bundles."""
