"""Streams of departures and of viewport requests, each batch answered by the batch operators."""
