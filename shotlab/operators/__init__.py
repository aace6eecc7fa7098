"""DataFrame operators (sampling, labels, demonstrations, prompts, features, fits, metrics)."""
