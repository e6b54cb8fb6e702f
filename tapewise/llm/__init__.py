"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
``tapewise.llm.registry`` when it is present.
"""
