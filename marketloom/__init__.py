"""Batch and streaming data work of an online shop, written for Spark."""
