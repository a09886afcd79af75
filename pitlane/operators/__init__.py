"""Relational operators: as-of visibility, schedules, rankings and portfolio arithmetic."""
