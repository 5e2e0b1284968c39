"""Table operators: stations, streets, access, schedules, graphs, statistics."""
