"""Operators: functions from DataFrames and parameters to a DataFrame.

They neither collect nor write. Frames that carry the fleet key
(`instance_id`) are processed per fleet member.
"""
