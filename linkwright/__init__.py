"""Record linkage and training-data operators expressed as Spark plans."""
