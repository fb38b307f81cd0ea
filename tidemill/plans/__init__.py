"""Chains of operations, fitted preparation, experiments, snapshots and run history."""
