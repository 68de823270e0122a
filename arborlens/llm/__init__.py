"""Operators on texts for training data: hand-written sources, packing, mixing and splitting."""
