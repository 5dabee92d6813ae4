"""Evidence analytics on Spark: retrieval, graph selection and evaluation as DataFrame plans."""
