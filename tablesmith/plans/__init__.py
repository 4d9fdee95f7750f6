"""End-to-end runs: a numbered source table in, target rows, issue log and reconciliation out."""
