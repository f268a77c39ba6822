"""Batch and streaming jobs that search, compare and rewrite front-end source code by its class and style tokens."""
