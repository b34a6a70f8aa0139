"""Table operators for everyday analytics work, written as Spark jobs.

Every operator takes and returns DataFrames; the modules are grouped into
``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (table transformations), ``streaming`` (incremental loads) and
``plans`` (the registered queries with their SQL counterparts).
"""
