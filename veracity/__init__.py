"""veracity: confidence-calibration analytics on Spark DataFrames.

Sub-packages:
  functions  - Column-level rules (text stripping, response parsing, scoring)
  operators  - DataFrame-level jobs (ingest, prompts, attempts, metrics, clustering,
               training rows, run logs)
  sources    - readers and writers (JSON shapes, metric logs, snapshots)
  plans      - derived views over the driver tables and the query catalogue
  streaming  - Structured Streaming calibration
"""

from veracity.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
