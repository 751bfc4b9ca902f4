"""codeloom: structural code intelligence and record hygiene as Spark DataFrame operators."""
