"""tablewright: table profiling, safe CSV loading, many-table copies, run-log reports and
desired-vs-actual reconciliation, written as ordinary Spark DataFrame operators.

Every operator takes DataFrames (or a session and paths) and returns DataFrames. The work
is declared with public DataFrame/SQL calls only, so Catalyst plans it and executors run it.
"""

from tablewright.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
