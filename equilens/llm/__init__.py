"""Operations of a training-data pipeline: tokenising, filtering, sharding, deduplication."""
