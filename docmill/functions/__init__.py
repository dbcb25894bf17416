"""Column functions: text, labels, dates, numbers, masking, confidence, payload."""
