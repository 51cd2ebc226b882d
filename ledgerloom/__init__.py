"""Document analytics on Spark: spans, rules, registers, classification algebra and publishing."""
