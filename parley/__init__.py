"""parley: conversation, completion, log and settings tables as Spark jobs.

Subpackages:

* ``functions`` - Column -> Column rules (native expressions);
* ``operators`` - DataFrame -> DataFrame operators O1-O31;
* ``sources`` - multi-line logs, notebooks and shell histories (read/write);
* ``streaming`` - Structured Streaming forms with per-key state;
* ``plans`` - the skew-safe ordered scan, end-to-end paths and the query
  catalog used by ``__spark_entry__``.
"""
