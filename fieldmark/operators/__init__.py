"""Operators: preparation, validation, sampling, fitting, inference, selection, comparison."""
