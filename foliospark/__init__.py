"""foliospark: document-image text extraction and corpus preparation as Spark dataflow."""
