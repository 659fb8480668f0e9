"""Readers of matrices, sequences, labels and id lists; views over tables; the stored dataset."""
