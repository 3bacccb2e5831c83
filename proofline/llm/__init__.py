"""Operators for preparing training text: filters, duplicate removal, scoring, search and mixing.

Nothing outside this folder imports it. ``queries`` registers one query per operator.
"""
