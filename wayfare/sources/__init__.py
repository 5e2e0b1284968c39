"""Scans and sinks: GTFS, GeoJSON, saved Overpass JSON, the curated relation, tile partitions."""
