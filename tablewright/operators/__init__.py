"""DataFrame operators: profiler, suggestions, domains, reports, reconciliation, checks,
column catalogue."""
