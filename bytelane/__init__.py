"""bytelane: byte-corpus sampling and training-run analytics on Spark DataFrames.

Sub-packages:
  sources    scans and sinks (tables, byte corpora, question JSON, logs)
  functions  column expressions (bytes, tokens, pixels, scoring)
  operators  DataFrame -> DataFrame operators (offsets, windows, runs, top-N ...)
  plans      epoch / batch / budget plan tables
  streaming  Structured Streaming byte and metric streams
"""

__version__ = "0.1.0"
