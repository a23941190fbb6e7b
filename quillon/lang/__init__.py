"""The text language: tokens, syntax, evaluation."""
