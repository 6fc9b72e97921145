"""Imports every module that registers queries."""

from barline.plans import clean, featuresets, ingest, joins, models, scoring, signals, statistics, streams, textnews, windows  # noqa: F401
