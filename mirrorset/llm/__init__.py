"""Training-data operators: scoring, mixing, encoding, identification, privacy and near copies."""
