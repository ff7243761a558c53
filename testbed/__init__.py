"""Maps the driver's tables into the shapes the library expects."""
