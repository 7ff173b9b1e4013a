"""Legal-citation detection, verification and evaluation as Spark plans."""
