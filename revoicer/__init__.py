"""Spark-first analytics for speech-localisation data: timelines, packing, scoring, audits."""
