"""Operations of large training-data pipelines over document tables."""
