"""Sitewright: site snapshots, table extracts and content rewriting as Spark DataFrame jobs."""
