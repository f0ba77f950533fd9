"""Lodestream: a Spark-first engine for data-system queries (changelogs, routing, snapshots, folds, streams)."""
