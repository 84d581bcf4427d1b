"""Security telemetry on Spark: log parsing, behavioural detectors, warehouse tables and analyst queries."""
