"""Column builders: filters, classification, notification lists."""
