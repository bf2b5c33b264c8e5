"""Operators of a training-data pipeline (quality rules, search, models,
tokenizers, archives, packing, de-duplication). Nothing else in the library
imports this subpackage."""
