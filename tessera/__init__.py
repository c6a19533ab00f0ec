"""Record linkage on Spark: declarative DataFrame operators, checked against SQL."""
