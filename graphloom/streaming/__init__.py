"""No streaming surface: keyspaces are filled in batches; a stream may call Engine.ingest in foreachBatch."""
