"""Behaviour analytics over large event tables, written as Spark DataFrame jobs."""
