"""Layer chains, jobs, models and governance measures built from operators."""
