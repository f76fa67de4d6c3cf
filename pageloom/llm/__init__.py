"""Operators for preparing language-model training data.

Nothing outside this package imports it. Every operator reads only the columns it
names, works row-wise where rows are independent, and treats a null text as empty
unless its docstring says otherwise.
"""
