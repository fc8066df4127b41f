"""Brindle: DataFrame jobs that build, publish and query a clean data set of dated listings."""
