"""The problem-report channel as a Structured Streaming job."""
