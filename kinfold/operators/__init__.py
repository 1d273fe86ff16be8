"""Relational steps: site filters, allele frequencies, pairs, sums over sites."""
