"""Queries of the core and the same results in SQL."""

from quarry.plans import sql_core, sql_reads, sql_samples
from quarry.plans.code import CODE
from quarry.plans.issue_changes import p1_found
from quarry.plans.reads import CORE
from quarry.plans.samples import SAMPLES
from quarry.plans.streams import STREAM_SQL, STREAMS
from quarry.plans.symbol_trees import p2_all_descendants, p2_descendants, p2_found, p2_paths

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p2_all_descendants": p2_all_descendants} | CORE | CODE | STREAMS | SAMPLES
ORACLES = {"p1_found": sql_core.P1, "p2_found": sql_core.P2, "p2_paths": sql_core.P2_PATHS, "p2_descendants": sql_core.P2_DESCENDANTS} | sql_reads.SQL | STREAM_SQL | sql_samples.SQL
