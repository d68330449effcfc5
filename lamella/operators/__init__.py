"""Operators on deep images: DeepImage in, DeepImage out."""
