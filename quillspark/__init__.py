"""quillspark: record curation and analytics operators written for Apache Spark."""
