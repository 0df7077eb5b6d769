"""Log and event analytics expressed as Spark plans."""
