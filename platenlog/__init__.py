"""Print-traffic analytics as Spark jobs.

Captured print messages, request logs, job registries, archived documents and
device announcements are DataFrames; every operator here takes DataFrames and
returns DataFrames (or Columns) and leaves the physical plan to Catalyst.
"""
