"""A trial log as a stream: windowed counts with late data, the latest state of each trial, an idempotent journal."""
