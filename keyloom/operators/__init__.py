"""Operators: functions from DataFrames to DataFrames, each for all keys at once.

A call for one key is the same function over a filtered input; the filter reaches the scan. Order
inside a key is always explicit, and nothing reads a clock or unseeded randomness: ``now_ms`` and
``seed`` are parameters.
"""
