"""Part of sitewright."""
