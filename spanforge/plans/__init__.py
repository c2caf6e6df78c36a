"""Registered queries and the SQL they are held against."""

#: modules of this folder that have QUERIES and SQL
CORE = ["general", "frames", "journals", "texts", "streams", "sources", "artifacts", "conformance", "records"]
