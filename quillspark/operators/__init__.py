"""DataFrame operators on segments, pairs, journals and reports."""
