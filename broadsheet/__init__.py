"""Broadsheet: page-segmentation analytics and corpus preparation on Spark."""
