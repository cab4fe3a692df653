"""Plan-level helpers: staging tables, progressive drivers, fluent pipelines."""
