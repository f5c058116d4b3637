"""Outputs: partitioned tables, manifests, reports, label files."""
