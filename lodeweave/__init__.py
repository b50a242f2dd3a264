"""Dataset discovery and augmentation on Spark."""
