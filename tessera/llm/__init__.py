"""Operators for preparing training corpora: ten DataFrame operators and their queries.

Nothing outside this subpackage imports it.
"""
