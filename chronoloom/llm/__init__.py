"""Operations of a training-data pipeline: filtering, matching, mixing, formatting and sharding."""
