"""Spark jobs for splice-derived peptide and k-mer analytics."""
