"""souk: marketplace analytics as set-based Spark jobs.

Subpackages:
  sources    typed marketplace tables, the test-data mapping and change feeds
  functions  column-level helpers (money, rating average, text rules)
  plans      reusable plan shapes (distributed prefix sums, last-per-key, upsert)
  operators  report, listing, change, checkout and data-quality jobs
  streaming  Structured Streaming forms of the trigger and scheduler logic
  oracle     DuckDB SQL text used as an independent correctness check
"""

from souk.session import get_session, scratch_dir  # noqa: F401
