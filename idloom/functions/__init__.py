"""Column functions for noisy OCR text: cleaning, words, labels, machine-readable zones, dates."""
