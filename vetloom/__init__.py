"""Document vetting, triple curation and graph question answering as Spark DataFrame pipelines."""
