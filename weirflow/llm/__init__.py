"""Operations of a training-data pipeline: reading, mixing, filtering, deduplicating, scoring, packing."""
