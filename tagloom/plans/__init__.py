"""Multi-operator plans and the storage helpers they share."""
