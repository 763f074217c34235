"""Sources and sinks: staged CSV loading, many-table mirroring and views, XML reports."""
