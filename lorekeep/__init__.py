"""lorekeep: a PySpark-native engine for agent-memory data.

Sub-packages: ``sources`` (tables and files), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (complete
queries with their SQL twins), ``streaming`` (Structured Streaming) and ``llm``
(training-data operators; nothing else imports it).
"""
