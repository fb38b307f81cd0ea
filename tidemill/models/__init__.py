"""Model registry, fits, scoring and tuning."""
