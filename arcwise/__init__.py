"""Arcwise: graph analytics on plain edge and node tables, expressed as Spark plans."""
