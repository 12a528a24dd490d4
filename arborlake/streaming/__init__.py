"""Progress of running jobs, and scans that arrive as a stream."""
