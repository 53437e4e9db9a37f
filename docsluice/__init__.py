"""Evidence-grounded document review and training-data preparation on Spark."""
