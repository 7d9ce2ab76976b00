"""Operators for preparing language-model training data; nothing else in the library imports them.

What is broadcast is made of numpy arrays and built-in types, as Python workers need not have the package.
"""
