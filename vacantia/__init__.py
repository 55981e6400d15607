"""Skill-demand analytics on PySpark: sources, operators, functions, plans and streams over job postings."""
