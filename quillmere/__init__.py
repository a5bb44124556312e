"""A document retrieval and text-processing engine of Spark DataFrame plans."""
