"""Reading, writing and materialising tables."""
