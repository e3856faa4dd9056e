"""The store, blobs and adapters of other tables."""
