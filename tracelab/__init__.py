"""Cluster-trace and experiment analytics on Spark."""
