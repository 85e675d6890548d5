"""Operators on tables of detections, tracks, embeddings and galleries: DataFrame in, DataFrame out."""
