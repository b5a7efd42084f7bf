"""Frame-stream analytics on Spark: codecs, elementary-stream rules and their inputs as DataFrame operators."""
