"""Scans and sinks: recordings, sidecars, calibration documents, commands, exports."""
