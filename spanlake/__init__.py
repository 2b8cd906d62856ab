"""Evidence-linked document segmentation analytics on Spark."""
