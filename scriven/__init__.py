"""Meeting transcripts and other timed text as Spark tables: intervals, packing, text rules, matching, scoring."""
