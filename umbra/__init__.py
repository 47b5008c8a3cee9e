"""Sky-event prediction as Spark dataflow."""
