"""The pipeline: clean, ledger, star, questions, profile."""
