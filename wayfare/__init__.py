"""Delivery-telemetry analytics on Spark."""
