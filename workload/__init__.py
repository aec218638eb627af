"""The study workload on the supplied tables: inputs, queries and their SQL."""
