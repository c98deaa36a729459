"""Identity-document extraction and text pipelines on Spark."""
